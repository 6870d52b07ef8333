"""The driver's tables as the engine's shapes: loci, features, series, sequences, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

EPOCH = "1992-01-01"


def loci(spark: SparkSession, d: str) -> DataFrame:
    """One closed interval a line item: chrom is the supplier, start the shipping day, length the quantity."""
    t = table(spark, d, "lineitem")
    start = F.datediff("l_shipdate", F.lit(EPOCH)).cast("long")
    return t.select(
        F.col("l_suppkey").alias("chrom"), start.alias("s"), (start + F.col("l_quantity").cast("long") - 1).alias("e"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("src"),
        F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("qty"),
    )


def features(spark: SparkSession, d: str) -> DataFrame:
    """One closed interval of 30 days an order; chrom spreads the customers over as many as there are suppliers."""
    start = F.datediff("o_orderdate", F.lit(EPOCH)).cast("long")
    n = table(spark, d, "supplier").count()
    return table(spark, d, "orders").select((F.col("o_custkey") % n).alias("chrom"), start.alias("s"), (start + 29).alias("e"), F.col("o_orderkey").alias("name"), F.col("o_orderpriority").alias("cls"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    """One gene of three exons an order, 60 days long, on both strands; each seventh has no coding span."""
    g = features(spark, d).select("chrom", "s", (F.col("s") + 59).alias("e"), "name", "cls")
    k, s = F.col("name") % 5, F.col("s")
    exon = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
    coding = F.col("name") % 7 != 0
    return g.select(
        "*", F.when(F.col("name") % 2 == 0, "+").otherwise("-").alias("strand"), F.array(exon(s, s + 9), exon(s + 15 + k, s + 29), exon(s + 40, s + 59)).alias("exons"),
        F.when(coding, s + 4 + k).otherwise(s).alias("ts"), F.when(coding, s + 50 - 2 * k).otherwise(s).alias("te"),
    )


def series(spark: SparkSession, d: str) -> DataFrame:
    """Values of each user at seconds."""
    return table(spark, d, "events").select(F.col("user_id").alias("chrom"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("pos"), "event_id", "event_type", F.floor(F.col("value") * 100).cast("long").alias("cents"))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """(row, label, col, value) of the embeddings, in millionths."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "label", F.posexplode("embedding").alias("col", "v")).withColumn("v", F.floor(F.col("v").cast("double") * 1_000_000).cast("long"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, locus, sample, grp, allele) of the embeddings: an allele of five by value, null where one in seven isn't covered."""
    v = F.abs("v")
    return matrix(spark, d).select(F.floor(F.col("col") / 32).alias("chrom"), F.col("col").cast("long").alias("locus"), F.col("row").alias("sample"), F.col("label").alias("grp"), F.when(v % 7 != 0, v % 5).alias("allele"))


def terms(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent) of an ontology: parts' keys below their halves and thirds."""
    k = table(spark, d, "part").select(F.col("p_partkey").alias("child"))
    return k.select("child", F.explode(F.array(*[F.floor(F.col("child") / n) for n in (2, 3)])).alias("parent")).filter("parent > 0").distinct()


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """(gene, term): orders' lines as genes on their parts' terms; a gene is one in a thousand of orders' keys."""
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("gene"), F.col("l_partkey").alias("term")).distinct()


#: The same shapes in DuckDB.
SQL = {
    "loci": "loci AS (SELECT l_suppkey AS chrom, s, s + qty - 1 AS e, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS src, l_returnflag AS flag, l_partkey AS part, qty FROM (SELECT *, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s, CAST(l_quantity AS BIGINT) AS qty FROM lineitem))",
    "features": "features AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS chrom, s, s + 29 AS e, o_orderkey AS name, o_orderpriority AS cls FROM (SELECT *, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s FROM orders))",
    "genes": "genes AS (SELECT chrom, s, s + 59 AS e, name, cls, CASE WHEN name % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN name % 7 <> 0 THEN s + 4 + name % 5 ELSE s END AS ts, CASE WHEN name % 7 <> 0 THEN s + 50 - 2 * (name % 5) ELSE s END AS te FROM features), exons AS (SELECT *, 1 AS nth, s AS xs, s + 9 AS xe, s + 15 + name % 5 AS next_s FROM genes UNION ALL SELECT *, 2, s + 15 + name % 5, s + 29, s + 40 FROM genes UNION ALL SELECT *, 3, s + 40, s + 59, NULL FROM genes)",
    "series": "series AS (SELECT user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_id, event_type, CAST(floor(value * 100) AS BIGINT) AS cents FROM events)",
    "calls": "calls AS (SELECT col // 32 AS chrom, col AS locus, row AS sample, label AS grp, CASE WHEN abs(v) % 7 <> 0 THEN abs(v) % 5 END AS allele FROM matrix)",
    "terms": "terms AS (SELECT DISTINCT p_partkey AS child, p_partkey // n AS parent FROM part, (VALUES (2), (3)) v(n) WHERE p_partkey // n > 0)",
    "annotations": "annotations AS (SELECT DISTINCT l_orderkey % 1000 AS gene, l_partkey AS term FROM lineitem)",
    "matrix": "matrix AS (SELECT vec_id AS row, label, col - 1 AS col, CAST(floor(CAST(embedding[col] AS DOUBLE) * 1000000) AS BIGINT) AS v FROM embeddings, range(1, 65) r(col))",
}


def with_(*names: str, then: str = "") -> str:
    return "WITH " + ", ".join([SQL[n] for n in names] + ([then] if then else []))
