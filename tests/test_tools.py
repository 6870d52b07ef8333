"""Whole jobs on small files: each tool runs, and says what it should."""

import random

import pytest

from lociflow import tools
from lociflow.sources import formats, lists, writers


@pytest.fixture
def files(tmp_path):
    rng = random.Random(7)
    g = "".join(rng.choice("ACGT") for _ in range(600))
    out = {
        "a.bed": "chr1\t0\t10\tx\t5\t+\nchr1\t8\t20\ty\t7\t-\nchr2\t5\t9\tz\t1\t+\n", "b.bed": "chr1\t15\t40\tf\t0\t+\nchr1\t100\t120\tg\t0\t-\nchr2\t0\t30\th\t0\t+\n",
        "genes.bed": "chr1\t0\t60\tg1\t0\t+\t5\t50\t0\t2\t20,20,\t0,40,\nchr2\t0\t30\tg2\t0\t-\t0\t0\t0\t1\t30,\t0,\n",
        "a.csv": '1,"e","hg","chr1",0,9,10\n2,"e","hg","chr1",8,19,12\n3,"e","mm","chr2",5,8,4\n', "b.csv": '7,"f","hg","chr1",15,39,25\n8,"f","hg","chr2",0,1,2\n',
        "s.fa": f">one first\n{g[:300]}\n>two second\n{g[250:550]}\n>two again\nACACACACACACNNNN\n", "t.fa": f">t\n{g}\n", "seqs.fa": f">chr1\n{g}\n>chr2\n{g[::-1]}\n",
        "r.fq": "@a/1\nACGTTGCAACG\n+\nIIIIIIIIIII\n@b/1\nACGTTGCAACG\n+\nIIIIIIIIIII\n@c/1\nANGT\n+\n####\n", "r2.fq": "@a/2\nGATACCGTTGC\n+\nIIIIIIIIIII\n@b/2\nTTTTTTTTTTT\n+\nIIIIIIIIIII\n@c/2\nACGT\n+\nIIII\n",
        "x.sam": "@HD\tVN:1.6\nr1\t64\tchr1\t1\t60\t5M\tchr2\t9\t30\tACGTA\tIIIII\nr2\t64\tchr1\t1\t60\t5M\tchr2\t9\t50\tACGTA\tIIIII\nr3\t0\tpre|chr3\t7\t60\t5M\t*\t0\t0\tACGTA\tIIIII\n",
        "p.psl": "50\t0\t0\t0\t0\t0\t0\t0\t+\tchr1\t600\t0\t50\tT\t900\t100\t150\t1\t50,\t0,\t100,\n", "blast.txt": "q\tchr1\t98.5\t50\t1\t0\t1\t50\t200\t151\t1e-20\t90.1\n",
        "snps.csv": ",".join(f'"h{i}"' for i in range(1, 20)) + "\n7,x,t,chr1,100,100,1,x,x,x,20,5,A,15,2,3,0,0,0.01\n", "w.wig": "fixedStep chrom=chr1 start=1 step=1 span=1\n2\n2\n4\n",
        "terms.obo": "[Term]\nid: GO:1\nname: root\n\n[Term]\nid: GO:2\nname: leaf\nis_a: GO:1\n", "genes.gaf": "".join(f"d\ti{i}\tg{i}\t\tGO:{1 + i % 2}\tr\tIDA\t\tP\t\t\tgene\t\t\t\n" for i in range(40)), "hits.csv": "gene,weight\n" + "".join(f"G{i},1\n" for i in range(1, 16, 2)),
        "x.agp": "o\t1\t4\t1\tW\tone\t1\t4\t-\no\t5\t7\t2\tN\t3\tscaffold\tyes\n", "x.maf": "a score=1\ns a.1 0 6 + 9 ACGTAC\ns b.1 0 6 + 9 ACGTTC\n\n", "m.csv": "id,f1,f2\na,1,2\n",
    }
    head = ",".join(f"h{i}" for i in range(1, 15))
    for k in (1, 2):
        out[f"c{k}.csv"] = f"{head}\n" + "".join(",".join(["1", n, "100", *["0"] * 9, "1.5", str(k * c)]) + "\n" for n, c in (("f", 3), ("g", 4)))
    for name, text in out.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "p1.pba").write_bytes(lists.pba_bytes("r1", "e", "ref", {"chr1": bytes([0xC0, 0, 3] * 150)}))
    (tmp_path / "p2.pba").write_bytes(lists.pba_bytes("r2", "e", "ref", {"chr1": bytes([0xC0, 3, 0] * 150)}))
    return tmp_path


def run(spark, files, name, *given, **options):
    """The tool's output folder; names of files stand for their paths."""
    given = [",".join(str(files / x) if (files / x).exists() else x for x in g.split(",")) for g in given]
    out = str(files / "out")
    options = {k: str(files / v) if isinstance(v, str) and (files / v).exists() else v for k, v in options.items()}
    tools.TOOLS[name](spark, *given, out, **options)
    return out


def table(spark, path, *columns):
    t = spark.read.option("header", True).csv(path)
    return sorted((tuple(r) for r in t.select(*columns).collect()), key=repr)


def bed(spark, path, *columns):
    return sorted(tuple(r) for r in formats.bed(spark, path).select(*(columns or ("chrom", "s", "e"))).collect())


def loci(spark, path):
    return sorted(tuple(r) for r in formats.loci_csv(spark, path).select("chrom", "s", "e").collect())


def fasta(spark, path):
    return {r["name"]: r["seq"] for r in formats.fasta(spark, path).collect()}


def test_bed_and_csv(spark, files):
    assert bed(spark, run(spark, files, "merge-bed", "a.bed")) == [("chr1", 0, 19), ("chr2", 5, 8)]


@pytest.mark.parametrize(
    "name, given, options, want",
    [
        ("merge-bed", ["a.bed"], {"stranded": True}, [("chr1", 0, 9), ("chr1", 8, 19), ("chr2", 5, 8)]), ("filter-bed", ["a.bed"], {"least": 5, "strand": "+"}, [("chr1", 0, 9)]), ("filter-bed", ["a.bed"], {"include": "2$"}, [("chr2", 5, 8)]),
        ("csv-to-bed", ["a.csv"], {}, [("chr1", 0, 9), ("chr1", 8, 19), ("chr2", 5, 8)]), ("sequence-bed", ["t.fa"], {}, [("t", 0, 599)]), ("regions", ["a.bed"], {"depth": 2}, [("chr1", 8, 9)]), ("remap-bed", ["a.bed", "p.psl"], {}, [("T", 100, 109), ("T", 108, 119)]),
    ],
)
def test_beds(spark, files, name, given, options, want):
    assert bed(spark, run(spark, files, name, *given, **options)) == want


@pytest.mark.parametrize(
    "name, given, options, want",
    [
        ("bed-to-csv", ["a.bed"], {}, [("chr1", 0, 9), ("chr1", 8, 19), ("chr2", 5, 8)]), ("psl-to-csv", ["p.psl"], {}, [("T", 100, 149)]),
        ("csv-sets", ["a.csv", "b.csv"], {}, [("chr1", 15, 19)]), ("csv-sets", ["a.csv", "b.csv"], {"mode": "union"}, [("chr1", 0, 39), ("chr2", 0, 1), ("chr2", 5, 8)]), ("csv-sets", ["a.csv", "b.csv"], {"mode": "neither"}, [("chr2", 2, 4)]), ("csv-sets", ["a.csv", "b.csv"], {"mode": "ref_only", "least": 5}, [("chr1", 0, 14)]),
        ("filter-csv", ["a.csv"], {"species": "HG", "least": 11}, [("chr1", 8, 19)]), ("filter-csv", ["a.csv"], {"exclude_loci": "b.csv"}, [("chr1", 0, 9), ("chr2", 5, 8)]), ("filter-csv", ["a.csv"], {"overlapped": "no"}, [("chr2", 5, 8)]), ("dropouts", ["a.csv", "b.csv"], {"least": 5}, [("chr1", 0, 9), ("chr1", 8, 19), ("chr2", 5, 8)]),
    ],
)
def test_elements(spark, files, name, given, options, want):
    assert loci(spark, run(spark, files, name, *given, **options)) == want


@pytest.mark.parametrize(
    "name, given, options, columns, want",
    [
        ("blast-to-csv", ["blast.txt"], {}, ["chrom", "s", "e"], [("chr1", "150", "199")]), ("reject-reasons", ["a.csv"], {"least": 5}, ["reason", "n"], [("accepted", "2"), ("short", "1")]), ("length-points", ["s.fa"], {"points": "50"}, ["nxx", "length"], [("50", "300")]),
        ("tandem-repeats", ["s.fa"], {}, ["id", "unit", "n"], [("two", "AC", "6")]), ("read-quality", ["r.fq"], {}, ["q"], [("2",)] * 4 + [("40",)] * 11), ("stack-reads", ["r.fq"], {}, ["seq", "n"], [("ACGTTGCAACG", "2"), ("ANGT", "1")]),
        ("count-features", ["a.bed", "b.bed"], {}, ["name", "reads"], [("f", "1"), ("h", "1")]), ("gene-regions", ["a.bed", "genes.bed"], {"distance": 5}, ["region", "n"], [("CDS", "2"), ("intergenic", "1")]), ("assign-genes", ["a.bed", "genes.bed"], {}, ["gene", "how"], [("g1", "0"), ("g1", "0"), ("g2", "0")]),
        ("distances", ["a.bed", "b.bed"], {}, ["s", "after"], [("0", "5"), ("5", None), ("8", "80")]), ("feature-depth", ["w.wig", "a.bed"], {}, ["name", "total"], [("x", "8.0")]), ("scaffold", ["x.sam"], {"least": 2}, ["a", "b", "n", "gap"], [("chr1", "chr2", "2", "40.0")]),
        ("alignment-statistics", ["x.maf"], {}, ["columns", "aligned", "identical"], [("6", "6", "5")]), ("conserved", ["x.maf"], {"least": 3}, ["s", "e"], [("0", "3")]), ("unpivot", ["m.csv"], {}, ["row", "col", "value"], [("a", "f1", "1.0"), ("a", "f2", "2.0")]), ("alleles", ["p1.pba,p2.pba"], {}, ["loci", "full", "same"], [("450", "150", "150")]),
        ("kmer-counts", ["t.fa"], {"size": 600}, ["n"], [("1",)]), ("composition", ["s.fa"], {"size": 5}, None, None), ("substitutions", ["s.fa"], {"size": 12, "most": 1}, None, None), ("kmer-markers", ["s.fa,t.fa"], {"size": 20}, None, None), ("differential", ["a.bed", "b.bed", "genes.bed"], {}, ["name", "control", "treated"], [("g1", "2", "1"), ("g2", "1", "1")]),
        ("local-matches", ["s.fa", "t.fa"], {"most": 1}, ["query", "t_s", "strand"], [("one", "0", "+"), ("two", "250", "+")]), ("enrich", ["hits.csv", "terms.obo", "genes.gaf"], {}, ["term", "k", "t", "n1", "n2"], [("GO:1", "8", "8", "40", "0"), ("GO:2", "8", "8", "20", "20")]),
    ],
)
def test_reports(spark, files, name, given, options, columns, want):
    out = run(spark, files, name, *given, **options)
    if columns is None:
        assert spark.read.option("header", True).csv(out).count() > 0
    else:
        assert table(spark, out, *columns) == sorted(want, key=repr)


def test_sequences(spark, files):
    g = fasta(spark, str(files / "t.fa"))["t"]
    assert sorted(fasta(spark, run(spark, files, "filter-fasta", "s.fa", unknown=3)).values()) == sorted([g[:300], g[250:550]])
    (files / "out").rename(files / "o1")
    tools.TOOLS["extract-fasta"](spark, str(files / "s.fa"), str(files / "out"), "^one", 5, 10)
    assert fasta(spark, str(files / "out")) == {"one": g[5:15]}
    (files / "out").rename(files / "o2")
    assert g[:550] in fasta(spark, run(spark, files, "assemble", "s.fa")).values()
    (files / "out").rename(files / "o3")
    d = fasta(spark, run(spark, files, "loci-fasta", "a.csv", "seqs.fa", before=2, after=1))
    assert d["1|chr1|0|9"] == g[:11] and d["2|chr1|8|19"] == g[6:21]
    (files / "out").rename(files / "o4")
    parts = fasta(spark, run(spark, files, "genome-of-parts", "x.agp", "s.fa"))
    assert parts["o:4"] == "NNN" and len(parts["o:0"]) == 4
    (files / "out").rename(files / "o5")
    assert set(fasta(spark, run(spark, files, "split-fasta", "t.fa"))) == {"t"}


def test_reads(spark, files):
    kept = formats.fastq(spark, run(spark, files, "filter-reads", "r.fq")).collect()
    assert [(r["seq"], r["quality"]) for r in kept] == [("ACGTTGCAACG", "I" * 11)]
    (files / "out").rename(files / "o1")
    assert fasta(spark, run(spark, files, "merge-pairs", "r.fq", "r2.fq", least=5)) == {"a": "ACGTTGCAACGGTATC"}
    (files / "out").rename(files / "o2")
    a = formats.sam(spark, run(spark, files, "filter-alignments", "x.sam", prefix="pre|")).collect()
    assert [(r["read"], r["chrom"], r["s"]) for r in a] == [("r3", "chr3", 6)]
    (files / "out").rename(files / "o3")
    assert len(fasta(spark, run(spark, files, "split-pairs", "t.fa", flip=True))) == 2


def test_pseudo_genome(spark, files):
    g = fasta(spark, str(files / "t.fa"))["t"]
    tools.TOOLS["pseudo-genome"](spark, str(files / "seqs.fa"), str(files / "out"), str(files / "at"), 10)
    whole = "".join(v for _, v in sorted((int(k.split(":")[1]), v) for k, v in fasta(spark, str(files / "out")).items()))
    at = {r["name"]: r["s"] for r in formats.bed(spark, str(files / "at")).collect()}
    assert whole[at["chr1"] : at["chr1"] + 600] == g and whole[at["chr2"] : at["chr2"] + 600] == g[::-1] and len(whole) == 1220


def test_variants_and_tables(spark, files):
    lines = [r[0] for r in spark.read.text(run(spark, files, "snps-to-variants", "snps.csv")).collect()]
    assert lines[-1] == "chr1\t101\t7\tA\tC,G\t.\tPASS\tDP=20"
    (files / "out").rename(files / "o1")
    assert [r[0] for r in spark.read.text(run(spark, files, "snps-to-variants", "snps.csv", style="pg")).collect()] == ["chr1\t100\t101\tA/C/G\t3\t15,2,3\t0,0,0"]
    tools.TOOLS["snp-tables"](spark, str(files / "snps.csv"), str(files / "db"), "e", "c")
    assert spark.read.parquet(str(files / "db/TblSnps")).first()["Acnt"] == 15
    tools.TOOLS["alignment-tables"](spark, str(files / "p.psl"), str(files / "db2"), "e")
    assert spark.read.parquet(str(files / "db2/TblAlignments")).first()["Score"] == 50
    paths = f"{files / 'c1.csv'},{files / 'c2.csv'}"
    tools.TOOLS["count-matrix"](spark, paths, str(files / "m"))
    assert sorted(r[0].split("\t")[1:] for r in spark.read.text(str(files / "m")).filter("value NOT LIKE 'feature%'").collect()) == [["3", "6"], ["4", "8"]]


def test_simulations_and_command_line(spark, files):
    tools.main(["simulate-reads", str(files / "reads"), str(files / "genome"), "--n", "20", "--size", "2000", "--length", "30", "--errors", "0"])
    assert len(fasta(spark, str(files / "reads"))) == 20 and sum(map(len, fasta(spark, str(files / "genome")).values())) == 4000
    tools.main(["simulate-counts", str(files / "counts"), "--features", "5", "--samples", "2"])
    assert spark.read.option("header", True).csv(str(files / "counts")).count() == 10
    tools.main(["merge-bed", str(files / "a.bed"), str(files / "merged"), "--gap", "3", "--stranded"])
    assert len(bed(spark, str(files / "merged"))) == 3
    tools.main(["coverage", str(files / "a.bed"), str(files / "wig")])
    assert formats.wig(spark, str(files / "wig")).filter("value = 2").count() == 1
    tools.main(["prefix-fasta", str(files / "t.fa"), str(files / "pre"), "p|"])
    assert list(fasta(spark, str(files / "pre"))) == ["p|t"]


def test_phylip(spark, tmp_path):
    writers.phylip(spark.createDataFrame([("b", "AC"), ("a", "GT")], "name string, seq string"), str(tmp_path / "p"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "p")).collect()] == ["2 2", "a          GT", "b          AC"]
