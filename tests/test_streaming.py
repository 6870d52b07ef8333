"""Streams over files against the same plans by hand."""

import datetime as dt

from pyspark.sql import functions as F

from lociflow.streaming import intervals

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "t timestamp, chrom string, s long, e long"


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def stream(spark, path, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")


def run(spark, out, path):
    q = intervals.appended(out, f"{path}/out", f"{path}/state", once=True)
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.parquet(f"{path}/out")


def test_depth_of_closed_windows(spark, tmp_path):
    rows = [(at(1), "a", 5, 14), (at(2), "a", 0, 3), (at(3), "b", 10, 10), (at(4), "b", 9, 8)]
    s = stream(spark, tmp_path, rows, [(at(200), "z", 0, 0)], [(at(201), "z", 0, 0)])
    got = run(spark, intervals.binned_depth(s, "t", "10 minutes", "5 minutes", 10), tmp_path)
    assert sorted(tuple(r) for r in got.select("chrom", "bin", "n", "bases").collect()) == [("a", 0, 2, 9), ("a", 1, 1, 5), ("b", 1, 1, 1)]


def test_first_seen_keeps_one_of_each(spark, tmp_path):
    s = stream(spark, tmp_path, [(at(1), "a", 1, 2), (at(1), "a", 1, 2), (at(2), "b", 1, 2)], [(at(3), "a", 1, 2), (at(3), "a", 1, 3)])
    got = run(spark, intervals.first_seen(s, ["chrom", "s", "e"], "t", "1 hour"), tmp_path)
    assert sorted(tuple(r) for r in got.select("chrom", "s", "e").collect()) == [("a", 1, 2), ("a", 1, 3), ("b", 1, 2)]


def test_rolled_up(spark, tmp_path):
    s = stream(spark, tmp_path, [(at(1), "a", 1, 5), (at(9), "a", 1, 7), (at(11), "a", 1, 1)], [(at(300), "z", 0, 0)], [(at(301), "z", 0, 0)])
    got = run(spark, intervals.rolled_up(s, ["chrom"], "t", "10 minutes", "1 minute", {"n": F.count("*"), "most": F.max("e")}), tmp_path)
    assert sorted(tuple(r) for r in got.select("chrom", "n", "most").collect()) == [("a", 1, 1), ("a", 2, 7)]


def test_annotated_pairs_come_once(spark, tmp_path):
    features = spark.createDataFrame([("a", 0, 200, "long"), ("a", 90, 95, "short"), ("b", 0, 9, "other")], "chrom string, s long, e long, name string")
    s = stream(spark, tmp_path, [(at(1), "a", 20, 150), (at(2), "b", 10, 20)], [(at(3), "a", 201, 300)])
    got = run(spark, intervals.annotated(s, features), tmp_path)
    assert sorted(tuple(r) for r in got.select("chrom", "s", "r_name").collect()) == [("a", 20, "long"), ("a", 20, "short")]
