"""Queries against DuckDB on the smallest tables, and hand-made intervals."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociflow import catalog
from lociflow.operators import graph, intervals

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, str):
        return v
    return "" if pd.isna(v) else round(float(v), 6)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    got, want = catalog.queries()[name](spark, D).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_islands_touching_nested_and_gaps(spark):
    rows = [("a", 0, 4), ("a", 5, 9), ("a", 11, 12), ("a", 11, 12), ("a", 20, 40), ("a", 25, 30), ("b", 3, 3)]
    df = spark.createDataFrame(rows, "chrom string, s long, e long")
    by = lambda gap: sorted(tuple(r) for r in intervals.merge_islands(df, ["chrom"], gap).select("chrom", "s", "e", "n").collect())
    assert by(0) == [("a", 0, 9, 2), ("a", 11, 12, 2), ("a", 20, 40, 2), ("b", 3, 3, 1)]
    assert by(1) == [("a", 0, 12, 4), ("a", 20, 40, 2), ("b", 3, 3, 1)]
    assert by(1) == sorted(tuple(r) for r in intervals.merge_islands(df, ["chrom"], 1).select("chrom", "s", "e", "n").collect())


def test_depth_keeps_bases(spark):
    df = spark.createDataFrame([("a", 0, 4), ("a", 2, 9), ("a", 100, 200)], "chrom string, s long, e long")
    d = intervals.depth_segments(df, ["chrom"], {"n": F.lit(True)})
    assert d.agg(F.sum(F.expr("n * (e - s + 1)"))).first()[0] == 5 + 8 + 101


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 3), (10, 11), (5, 5), (7, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 1, 10: 10, 11: 10}
    assert graph.connected_components(edges.filter("a > 99")).count() == 0
