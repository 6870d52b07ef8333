"""Alleles, CIGARs and series by hand."""

from pyspark.sql import functions as F

from lociflow.functions import alleles, cigar, sequence
from lociflow.operators import series as S


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_haploid_of_every_byte(spark):
    def one(p):
        for want in (3, 2, 1):
            for shift in (6, 4, 2, 0):
                if p >> shift & 3 == want:
                    return 3 << shift
        return 0

    assert column(spark, range(256), alleles.haploid, "int") == [one(p) for p in range(256)]


def test_diploid_and_single(spark):
    assert column(spark, [0, 0xC0, 0xE0, 0xA0, 0x90, 0x01], alleles.diploid, "int") == [0, 0xC0, 0xC0, 0xF0, 0xF0, 0x03]
    assert column(spark, [0, 0x40, 0x50, 0x03], alleles.single, "int") == [True, True, False, True]


def test_bases(spark):
    got = column(spark, [0xC0, 0x40, 0x90, 0xA0, 0x05, 0x50, 0x60, 0x0A, 0x06, 0x00, 0xF0, 0x15, 0xE0], alleles.bases, "int")
    assert got == ["A", "A", "A", "AC", "GT", "C", "AC", "T", "GT", "N", "N", "N", "N"]


def test_cigar(spark):
    values = ["10M2I3D5=4S", "*", "", None, "3M4M1X"]
    assert column(spark, values, cigar.aligned) == [15, 0, 0, 0, 8]
    assert column(spark, values, cigar.on_reference) == [18, 0, 0, 0, 8]
    assert column(spark, values, cigar.on_read) == [21, 0, 0, 0, 8]
    assert column(spark, ["3M4M1X", "2S2S", "*", None], cigar.coalesced) == ["7M1X", "4S", "*", None]


def test_sub_sequences(spark):
    got = column(spark, ["ACGTA", "", None], lambda c: sequence.sub_sequences(c, 3, 2))
    assert [None if x is None else [tuple(y) for y in x] for x in got] == [[(0, "ACG"), (2, "GTA"), (4, "A")], [], None]


def test_window_mean_by_hand(spark):
    rows = [(k, i, (i * 7) % 23 - 5) for k, n in (("few", 9), ("short", 12), ("long", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {(r.k, r.i): r.m for r in S.window_mean(df, ["k"], ["i"], "v", 15, "m").collect()}
    for key in ("few", "short", "long"):
        v = [x for k, _, x in rows if k == key]
        w = min(15, len(v))
        for i in range(len(v)):
            part = v[max(0, i - (w - w // 2)) : i + w // 2]
            assert got[key, i] == (v[i] if len(v) < 10 else int(sum(part) / len(part)))


def test_trim_and_fill(spark):
    df = spark.createDataFrame([("a", p) for p in (1, 2, 3, 4, 8, 9, 20)], "k string, p long")
    assert sorted(r.p for r in S.trim_runs(df, ["k"], "p", 1, 1).collect()) == [2, 3]
    calls = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("a", 4, None)], "k string, b long, c long")
    assert [r.f for r in S.filled_calls(calls, ["k"], "b", "c", "f").orderBy("b").collect()] == [5, 7, 7, 7]
