"""Readers, writers and sequence functions on small files, cut into splits of a few bytes where that matters."""

import random

import pytest
from pyspark.sql import functions as F

from lociflow.functions import sequence
from lociflow.sources import formats, writers


@pytest.fixture
def put(tmp_path):
    def write(text, name="in.txt"):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


@pytest.fixture(params=["134217728", "300"])
def splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_bed(spark, put, tmp_path):
    p = put("track name=x\n#c\nchr1\t10\t20\nchr2\t0\t30\tg\t7\t-\t0\t30\t0\t2\t5,10,\t0,20,\nchr3\tx\t9\n")
    df = formats.bed(spark, p)
    assert rows(df, "chrom", "s", "e", "name") == [("chr1", 10, 19, None), ("chr2", 0, 29, "g"), ("chr3", None, 8, None)]
    assert [tuple(b) for b in df.collect()[1]["blocks"]] == [(0, 4), (20, 29)]
    writers.bed(df.filter("s IS NOT NULL"), str(tmp_path / "out"))
    assert rows(formats.bed(spark, str(tmp_path / "out")), "chrom", "s", "e") == [("chr1", 10, 19), ("chr2", 0, 29)]


def test_gff_and_gtf(spark, put):
    df = formats.gff3(spark, put("##gff\nc\tx\tgene\t1\t10\t.\t+\t.\tID=g1;Name=a b;ID=g2\n")).collect()[0]
    assert (df["s"], df["e"], df["score"], df["attributes"]) == (0, 9, None, {"ID": "g1", "Name": "a b"})
    df = formats.gtf(spark, put('c\tx\texon\t5\t6\t1.5\t-\t0\tgene_id "g"; transcript_id "t;1";\n')).collect()[0]
    assert (df["s"], df["e"], df["score"], df["attributes"]) == (4, 5, 1.5, {"gene_id": "g", "transcript_id": "t;1"})


def test_fasta(spark, put, splits, tmp_path):
    want = {f"r{i}": "".join(random.Random(i).choices("ACGTacgtN", k=i * 7 % 150)) for i in range(60)}
    p = put("".join(f">{k} some > text\n" + "".join(s[j : j + 13] + "\n" for j in range(0, len(s), 13)) for k, s in want.items()))
    assert dict(rows(formats.fasta(spark, p), "name", "seq")) == want
    writers.fasta(formats.fasta(spark, p), str(tmp_path / "out"))
    assert dict(rows(formats.fasta(spark, str(tmp_path / "out")), "name", "seq")) == want


def test_fastq_whose_qualities_start_with_the_mark(spark, put, splits):
    rng = random.Random(5)
    want = sorted((f"r{i}", "ACGT" * (i % 5 + 1), rng.choice("@@I") + "".join(rng.choices("@+I#", k=4 * (i % 5 + 1) - 1))) for i in range(200))
    assert sorted(rows(formats.fastq(spark, put("".join(f"@{a} x\n{b}\n+\n{c}\n" for a, b, c in want))), "name", "seq", "quality")) == want


def test_sam(spark, put):
    p = put("@HD\tVN:1.6\nr1\t16\tchr1\t11\t60\t3S10M2D5M1I4M\t=\t40\t50\tACGT\tIIII\tNM:i:2\tRG:Z:a:b\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    a, b = formats.sam(spark, p).collect()
    assert (a["s"], a["e"], a["strand"], a["mate_chrom"], a["mate_s"], a["tags"]) == (10, 30, "-", "chr1", 39, {"NM": "i:2", "RG": "Z:a:b"})
    assert (b["strand"], b["tags"]) == ("+", {})


def test_wig_over_splits(spark, put, splits):
    text, want = "track type=wiggle_0\n", []
    for c in range(4):
        text += f"variableStep chrom=c{c} span={c + 1}\n"
        for i in range(1, 80):
            text += f"{i * 10} {i}.5\n"
            want.append((f"c{c}", i * 10 - 1, i * 10 - 1 + c, i + 0.5))
    assert sorted(rows(formats.wig(spark, put(text)), "chrom", "s", "e", "value")) == sorted(want)


def test_obo_over_splits(spark, put, splits):
    text = "format-version: 1.2\n\n" + "".join(f"[Term]\nid: GO:{i}\nname: t: {i}\nnamespace: p\nis_a: GO:{i + 2} ! x\nis_a: GO:{i + 1} ! y\n\n" for i in range(10, 40)) + "[Typedef]\nid: part_of\n"
    got = sorted(rows(formats.obo(spark, put(text)), "id", "name", "is_a"))
    assert got == [(f"GO:{i}", f"t: {i}", [f"GO:{i + 1}", f"GO:{i + 2}"]) for i in range(10, 40)]


def test_loci_csv_psl_gaf(spark, put):
    p = put('"id","type","species","chrom","start","end","len"\n1,"core","hg","chr1",5,9,5\n2,core,hg,"chr,2",0,0,1\n')
    assert rows(formats.loci_csv(spark, p), "src_id", "chrom", "s", "e", "len") == [(1, "chr1", 5, 9, 5), (2, "chr,2", 0, 0, 1)]
    psl = "\t".join("10 1 0 0 0 0 0 0 + q 20 0 11 t 99 5 16 2 5,6, 0,5, 5,10,".split())
    r = formats.psl(spark, put("psLayout version 3\n\n" + psl + "\n")).collect()[0]
    assert (r["matches"], r["q_end"], r["t_start"], r["t_end"], r["block_sizes"], r["t_starts"]) == (10, 10, 5, 15, [5, 6], [5, 10])
    assert rows(formats.gaf(spark, put("!c\nU\tP1\tsym\t\tGO:1\tref\tIEA\n")), "symbol", "go_id", "evidence", "taxon") == [("sym", "GO:1", "IEA", None)]


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTNacg",), ("AAAACCCC",), ("",), (None,)], "q string")
    c = F.col("q")
    assert rows(df, sequence.reverse_complement(c)) == [("cgtNACGT",), ("GGGGTTTT",), ("",), (None,)]
    assert rows(df, sequence.gc_percent(c))[1:] == [(50.0,), (None,), (None,)]
    assert rows(df, sequence.complexity_class(c, 10)) == [(0,), (3,), (3,), (None,)]
    assert rows(df.limit(1), sequence.opposite(F.lit("+")), sequence.without_isoform(F.lit("AT1.2.12")), sequence.one_blank(F.lit(" a \n b "))) == [("-", "AT1.2", "a b")]
