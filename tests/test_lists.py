"""Readers of lists, small tables and packed base alleles on hand-made files."""

import random

import pytest

from lociflow.sources import formats, lists


@pytest.fixture
def put(tmp_path):
    def write(text, name="in.txt"):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_sizes_and_kinds(spark, put):
    assert rows(lists.sizes(spark, put("a,b\n1,2,3\n"))) == [(2, 3, 2.5, 5)]
    p = put("\n>x one\nACGT\nAC\n>y\nA\n", "f")
    assert lists.sequence_kind(spark, p) == "fasta" and lists.sequence_kind(spark, put("@r\nA\n+\nI\n", "q")) == "fastq" and lists.sequence_kind(spark, put("x\n", "n")) is None
    f = formats.fasta(spark, put(">x one\nACGT\nAC\n>y\nA\n", "g"))
    assert rows(lists.sequence_sizes(f)) == [(2, 5, 3.0, 6, 3.5)]
    assert rows(lists.of_descriptor(f, "X o"), "name") == [("x",)]
    assert rows(lists.sub_sequence(f, 1, 3), "name", "seq") == [("x", "CGT"), ("y", "")]


def test_lists(spark, put):
    assert rows(lists.ids(spark, put('1\n"2",x\n1\nz\n'))) == [(1,), (2,)]
    assert rows(lists.names(spark, put('a,1\n"b"\na\n', "n"))) == [("a",), ("b",)]
    assert rows(lists.synonyms(spark, put("a\tb\nc, d\ne\n", "s"))) == [("a", "b"), ("c", "d")]
    assert rows(lists.gene_classes(spark, put("gene,cls\ng,x\n", "c"))) == [("g", "x")]
    assert rows(lists.weighted_genes(spark, put("gene,p,padj\ng,0.01,0.25\nh,0.2,0.9\n", "w"), 0.5)) == [("g", 0.75)]
    assert rows(lists.chrom_sizes(spark, put("a\t0\t10\na\t5\t30\nb\t1\t2\n", "b"))) == [("a", 30), ("b", 2)]


def test_elements(spark, put):
    p = put('1,"core","hg","chr1",10,19,10\n2,"core","hg","chr1",30,99,70\n')
    assert rows(lists.zones(spark, p)) == [("chr1", 10, 19, "*"), ("chr1", 30, 99, "*")]
    assert rows(lists.group_cores(spark, p, 20, 100), "chrom", "s", "e", "name") == [("chr1", 30, 99, "core_2")]


def test_counts(spark, put):
    line = lambda n, length, rpkm, reads: ",".join(["1", n, str(length), *["0"] * 9, str(rpkm), str(reads)])
    head = ",".join(f"h{i}" for i in range(1, 15))
    a = lists.feature_counts(spark, put(f"{head}\n{line('f', 100, 1.5, 7)}\n{line('g', 5, 1, 9)}\n{line('f', 50, 0.5, 1)}\n"), 10, 1000, 1)
    assert rows(a) == [("f", 100, 1.5, 7), ("f", 50, 0.5, 1)]
    assert rows(lists.sample_counts({"s": a, "t": a.filter("length = 50")})) == [("s", "f", 8, 2.0), ("t", "f", 1, 0.5)]


def test_snps_and_groups(spark, put):
    cells = ["src,A,9,10,1,2,3,4,0", "src,C,8,10,4,3,2,1,0"]
    assert rows(lists.marker_snps(spark, put("1,chr1,55,G," + ",".join(cells) + "\n"), ["x", "y"]), "site", "chrom", "s", "ref", "species", "base", "score", "a", "n") == [(1, "chr1", 55, "G", "x", "A", 9, 1, 0), (1, "chr1", 55, "G", "y", "C", 8, 4, 0)]
    assert rows(lists.distances(spark, put("chrom,at,d\nc,5,2\n", "d"))) == [("c", 5, 2)]
    assert rows(lists.snp_track(spark, put("585\tchr1\t9\t10\trs1\t0\t+\tA\tA\tA/G\n", "t"))) == [("chr1", 9, 9, "rs1", "+", ["A", "G"])]
    assert rows(lists.grouping(spark, put("chrom,start,len,f1,f2\nc,0,100,1,2\n", "g"))) == [("c", 0, 100, "f1", 1), ("c", 0, 100, "f2", 2)]
    assert rows(lists.bin_specs(spark, put("chrom,s,size,a,b,c\nc,0,10,1,5,3\n", "b"))) == [("c", 0, 10, 1, 5, 3)]


def test_terms(spark, put):
    assert rows(lists.gene_terms(spark, put("g1\tGO:0000001,GO:0000002\ng2 none\ng1 GO:0000001\n"))) == [("g1", "GO:0000001"), ("g1", "GO:0000002")]
    assert rows(lists.gff_terms(spark, put("c\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Ontology_term=GO:0000003\n", "g"))) == [("g1", "GO:0000003")]


def test_contaminants_and_reads(spark, put):
    assert rows(lists.contaminants(spark, put(">a @2 x\nacgt\n>b\nGG\n"))) == [("a", 2, "ACGT"), ("b", 0, "GG")]
    r = spark.createDataFrame([("AACGT",), ("TACGA",), ("GG",)], "seq string")
    assert rows(lists.processed_reads(r, 1, 1)) == [("ACG", 2)] and rows(lists.processed_reads(r, keep_copies=True)) == [("AACGT", 1), ("GG", 1), ("TACGA", 1)]


def test_pba(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lists, "PBA_BLOCK", 50)
    rng = random.Random(1)
    chroms = {"chr1": bytes(rng.choice([0, 0, 0xC0, 0x3F]) for _ in range(130)), "c2": bytes(7), "chr3": bytes([1])}
    (tmp_path / "a.pba").write_bytes(lists.pba_bytes("r1", "e", "ref", chroms))
    want = sorted((("r1", c, i, b) for c, a in chroms.items() for i, b in enumerate(a) if b), key=repr)
    assert rows(lists.pba(spark, [str(tmp_path / "a.pba")])) == want
    (tmp_path / "b.pba").write_bytes(b"x" * 700)
    with pytest.raises(ValueError):
        lists.pba(spark, [str(tmp_path / "b.pba")])
