"""Readers and writers of tables and alignment blocks: round trips and hand-made files, cut into small splits."""

import gzip
import struct
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lociflow.sources import adapters, formats, tables, writers

D = "/root/testdata/sf0.001"


@pytest.fixture
def put(tmp_path):
    def write(text, name="in.txt"):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


@pytest.fixture(params=["134217728", "60"])
def splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(a, b, *columns):
    assert rows(a, *columns) == rows(b, *columns)


@pytest.mark.parametrize("values, is_heading", [(["a", "b"], True), (["1", "b"], False), (["a", None, "", " "], False), (["a", None, "b"], True), ([None], False), (["-1e3"], False)])
def test_likely_heading(values, is_heading):
    assert tables.likely_heading(values) == is_heading


def test_delimited(spark, put):
    t = tables.delimited(spark, put('gene,"weight, scaled"\nx,1\n"y, z",2\n'))
    assert t.columns == ["gene", "weight, scaled"]
    assert [tuple(r) for r in t.orderBy("gene").collect()] == [("x", "1"), ("y, z", "2")]
    t = tables.delimited(spark, put("1,a\n2,b\n", "n.txt"))
    assert t.columns == ["c1", "c2"] and t.count() == 2


def test_kind_of(spark, put):
    assert tables.kind_of(spark, put("@HD\tVN:1.6\n")) == "sam"
    assert tables.kind_of(spark, put("track x\nchr1\t1\t2\n", "b")) == "bed"
    assert tables.kind_of(spark, put("1,x,y\n", "c")) == "csv"
    assert tables.kind_of(spark, put("words\n", "d")) is None


def test_matrix_classes_hits(spark, put):
    assert rows(tables.matrix(spark, put("id,f1,f2\na,1,2\nb,3,\n")), "row", "col", "value") == [("a", "f1", 1.0), ("a", "f2", 2.0), ("b", "f1", 3.0), ("b", "f2", None)]
    assert rows(tables.classes(spark, put("id,cls\na,x\n", "c")), "row", "cls") == [("a", "x")]
    assert rows(tables.hits(spark, put("gene,weight\na,2.5\nb,\n", "h")), "gene", "weight") == [("a", 2.5), ("b", 1.0)]
    p = put("old,new\nchr1,1\n", "r")
    assert tables.renames(spark, p) == {"chr1": "1"}
    names = spark.createDataFrame([("chr1", "1")], "name string, to string")
    assert rows(tables.renamed(spark.createDataFrame([("chr1",), ("chr2",)], "chrom string"), "chrom", names), "chrom") == [("1",), ("chr2",)]


def test_snps(spark, put):
    head = ",".join(f'"h{i}"' for i in range(1, 20))
    line = "7,x,t,chr1,100,100,1,x,x,x,20,5,A,1,2,3,4,0,0.01"
    assert rows(tables.snps(spark, put(f"{head}\n{line}\n")), "site", "chrom", "s", "bases", "mismatches", "ref", "a", "c", "g", "t", "n", "rate") == [(7, "chr1", 100, 20, 5, "A", 1, 2, 3, 4, 0, 0.01)]


def test_blast_and_agp(spark, put):
    assert rows(tables.blast(spark, put("q\tchr1\t98.5\t50\t1\t0\t1\t50\t200\t151\t1e-20\t90.1\n")), "query", "chrom", "s", "e", "strand", "q_s", "q_e") == [("q", "chr1", 150, 199, "-", 0, 49)]
    parts = tables.agp(spark, put("o\t1\t4\t1\tW\tc1\t1\t4\t-\no\t5\t7\t2\tN\t3\tscaffold\tyes\n", "a"))
    assert rows(parts, "object", "s", "e", "part", "gap", "component", "c_s", "c_e") == [("o", 0, 3, 1, None, "c1", 0, 3), ("o", 4, 6, 2, 3, None, None, None)]
    contigs = spark.createDataFrame([("c1", "AACGT")], "name string, seq string")
    assert rows(tables.assembled(parts, contigs), "part", "s", "seq") == [(1, 0, "CGTT"), (2, 4, "NNN")]


def test_maf_axt(spark, put, splits, tmp_path):
    text = "##maf version=1\n" + "".join(f"a score={i}.5\ns hg.chr{i} {i} 4 + 100 ACG-T\ns mm.chr{i} {i + 5} 4 - 90 AC-GT\n\n" for i in range(6))
    m = tables.maf(spark, put(text))
    assert rows(m, "score", "src", "s", "size", "strand", "src_size", "seq") == sorted([(i + 0.5, f"hg.chr{i}", i, 4, "+", 100, "ACG-T") for i in range(6)] + [(i + 0.5, f"mm.chr{i}", i + 5, 4, "-", 90, "AC-GT") for i in range(6)], key=repr)
    assert m.select("block").distinct().count() == 6
    writers.maf(m, str(tmp_path / "maf"))
    same(m, tables.maf(spark, str(tmp_path / "maf")), "score", "src", "s", "size", "strand", "src_size", "seq")
    text = "".join(f"{i} chr1 {10 * i + 1} {10 * i + 5} chr2 7 11 - 3500\nACGTA\nAC-TA\n\n" for i in range(5))
    a = tables.axt(spark, put(text, "x.axt"))
    assert rows(a, "block", "s", "e", "other_s", "other_e", "strand", "score", "seq", "other_seq") == sorted([(i, 10 * i, 10 * i + 4, 6, 10, "-", 3500.0, "ACGTA", "AC-TA") for i in range(5)], key=repr)


def test_wig_steps(spark, put, splits, tmp_path):
    text = "track type=wiggle_0\nfixedStep chrom=a start=11 step=5 span=2\n" + "".join(f"{i}\n" for i in range(40)) + "variableStep chrom=b span=3\n7 1.5\n20 2\nfixedStep chrom=c start=1 step=1\n" + "".join(f"-{i}\n" for i in range(30))
    want = [("a", 10 + 5 * i, 11 + 5 * i, float(i)) for i in range(40)] + [("b", 6, 8, 1.5), ("b", 19, 21, 2.0)] + [("c", i, i, float(-i)) for i in range(30)]
    w = tables.wig_steps(spark, put(text))
    assert [(c, s, e, v + 0.0) for c, s, e, v in rows(w, "chrom", "s", "e", "value")] == [(c, s, e, v + 0.0) for c, s, e, v in sorted(want, key=repr)]
    writers.wig(w, str(tmp_path / "wig"))
    same(w, formats.wig(spark, str(tmp_path / "wig")), "chrom", "s", "e", "value")


def bam_bytes():
    def record(name, flag, ref, pos, cigar, seq, quality):
        ops = b"".join(struct.pack("<I", n << 4 | tables.BAM_OPS.index(o)) for n, o in cigar)
        codes = [tables.BAM_BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + bytes(quality)
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 4) + b"@CO\n" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    return head, [record("r1", 16, 0, 99, [(3, "M"), (1, "I"), (1, "M")], "ACGTN", [30] * 5), record("r2", 4, -1, -1, [], "AC", [255, 255])]


def test_bam(spark, tmp_path):
    head, records = bam_bytes()
    # Members may end anywhere, also within a record.
    data = head + b"".join(records)
    (tmp_path / "x.bam").write_bytes(b"".join(gzip.compress(data[a : a + 37]) for a in range(0, len(data), 37)))
    out = rows(tables.bam(spark, [str(tmp_path / "x.bam")]), "read", "flag", "chrom", "s", "mapq", "cigar", "seq", "quality")
    assert out == [("r1", 16, "chr1", 99, 60, "3M1I1M", "ACGTN", "?????"), ("r2", 4, "*", -1, 60, "*", "AC", "*")]


def test_bins(spark):
    """Against the published formulas of the binning scheme."""

    def reg2bin(b, e):
        for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
            if b >> shift == e >> shift:
                return first + (b >> shift)
        return 0

    ranges = [(0, 0), (0, 16383), (16383, 16384), (1 << 20, (1 << 20) + 5), (5, 1 << 28), ((1 << 29) - 1, (1 << 29) - 1), (131071, 131072)]
    df = spark.createDataFrame(ranges, "s long, e long")
    out = df.select("s", "e", tables.range_bin(F.col("s"), F.col("e")).alias("b"), tables.smallest_bin(F.col("s"), F.col("e")).alias("c"), tables.overlapping_bins(F.col("s"), F.col("e")).alias("all")).collect()
    for r in out:
        want = reg2bin(r["s"], r["e"])
        over = {0} | {first + i for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)) for i in range(r["s"] >> shift, (r["e"] >> shift) + 1)}
        assert r["b"] == r["c"] == want and set(r["all"]) == over


def test_round_trips_of_driver_tables(spark, tmp_path):
    """Whole tables through a file and back."""
    g = adapters.genes(spark, D).select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "s", "e", F.col("name").cast("string").alias("name"), "strand", "exons", "ts", "te")
    writers.bed12(g, str(tmp_path / "bed"), track="genes")
    back = formats.bed(spark, str(tmp_path / "bed"))
    same(g, back, "chrom", "s", "e", "name", "strand")
    assert rows(g, F.col("exons").cast("string")) == rows(back, F.col("blocks").cast("string"))
    l = adapters.loci(spark, D).select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "s", "e", "strand", F.lit("lineitem").alias("source"), F.lit("element").alias("type"), F.create_map(F.lit("ID"), F.col("src").cast("string")).alias("attributes"))
    writers.gff3(l, str(tmp_path / "gff"))
    same(l.withColumn("id", F.col("attributes")["ID"]), formats.gff3(spark, str(tmp_path / "gff")).withColumn("id", F.col("attributes")["ID"]), "chrom", "s", "e", "strand", "source", "type", "id")
    c = l.withColumns({"src_id": F.monotonically_increasing_id(), "el_type": F.lit("x, y"), "species": F.lit("z")})
    writers.loci_csv(c, str(tmp_path / "csv"))
    same(c, formats.loci_csv(spark, str(tmp_path / "csv")), "el_type", "species", "chrom", "s", "e")
    v = l.select("chrom", "s", "e", F.col("s").cast("double").alias("value"))
    writers.bedgraph(v, str(tmp_path / "graph"))
    same(v, formats.bed(spark, str(tmp_path / "graph")).select("chrom", "s", "e", F.col("name").cast("double").alias("value")), "chrom", "s", "e", "value")


def test_sam_and_psl(spark, tmp_path):
    a = spark.createDataFrame([("r1", 16, "chr1", 9, 60, "5M", "=", 20, 0, "ACGTA", "IIIII", {"NM": "i:1"}), ("r2", 4, "*", -1, 0, "*", "*", -1, 0, "A", "I", {})], "read string, flag int, chrom string, s long, mapq int, cigar string, mate_chrom string, mate_s long, tlen long, seq string, quality string, tags map<string,string>")
    writers.sam(a, str(tmp_path / "sam"), {"chr1": 1000})
    back = formats.sam(spark, str(tmp_path / "sam"))
    same(a.drop("mate_chrom"), back, "read", "flag", "chrom", "s", "mapq", "cigar", "seq", "quality")
    assert back.filter("read = 'r1'").first()["tags"] == {"NM": "i:1"}
    p = spark.createDataFrame([tuple([1] * 8 + ["+", "q", 50, 0, 49, "t", 100, 10, 59, 1, [50], [0], [10]])], ", ".join(f"{n} {'string' if n in ('strand', 'q_name', 't_name') else 'array<long>' if n in ('block_sizes', 'q_starts', 't_starts') else 'long'}" for n in formats.PSL))
    writers.psl(p, str(tmp_path / "psl"))
    same(p, formats.psl(spark, str(tmp_path / "psl")), *[F.col(n).cast("string") for n in formats.PSL])


def test_vcf_pgsnp_matrix(spark, tmp_path):
    v = spark.createDataFrame([("chr1", 9, "x", "A", "C", "0/1"), ("chr1", 12, None, "G", "T", None)], "chrom string, s long, name string, ref string, alt string, s1 string")
    writers.vcf(v.coalesce(1), str(tmp_path / "vcf"), ["s1"])
    lines = [r[0] for r in spark.read.text(str(tmp_path / "vcf")).collect()]
    assert lines[:2] == ["##fileformat=VCFv4.1", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1"]
    assert lines[2:] == ["chr1\t10\tx\tA\tC\t.\tPASS\t.\tGT\t0/1", "chr1\t13\t.\tG\tT\t.\tPASS\t.\tGT\t./."]
    writers.pg_snp(spark.createDataFrame([("chr1", 9, 3, 0, 4, 0)], "chrom string, s long, a long, c long, g long, t long"), str(tmp_path / "pg"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "pg")).collect()] == ["chr1\t9\t10\tA/G\t2\t3,4\t0,0"]
    m = spark.createDataFrame([("g1", "s1", 2), ("g1", "s2", 3), ("g1", "s1", 1), ("g2", "s1", 5)], "gene string, sample string, n long")
    writers.count_matrix(m, "gene", "sample", "n", ["s1", "s2"], str(tmp_path / "m"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["gene\ts1\ts2", "g1\t3\t3"]


@pytest.mark.parametrize("kind", ["graphml", "gexf"])
def test_graphs(spark, tmp_path, kind):
    nodes = spark.createDataFrame([(f"n<{i}>",) for i in range(20)], "node string")
    edges = spark.createDataFrame([(f"n<{i}>", f"n<{i + 1}>", i) for i in range(19)], "a string, b string, size long")
    getattr(writers, kind)(nodes, edges, str(tmp_path / kind))
    import glob

    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/{kind}/part-*")))
    tags = [x.tag.rpartition("}")[2] for x in ET.fromstring(text).iter()]
    assert tags.count("node") == 20 and tags.count("edge") == 19


def test_xml_entries(spark, tmp_path):
    writers.xml_entries(spark.createDataFrame([("a<b", 1), (None, 2)], "name string, n int"), str(tmp_path / "x"), "entry")
    assert rows(spark.read.text(str(tmp_path / "x")), "value") == [('<entry name="" n="2"/>',), ('<entry name="a&lt;b" n="1"/>',)]
