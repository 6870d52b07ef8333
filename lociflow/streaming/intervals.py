"""Loci and values as they arrive: depth of bins, first sightings, sums of series, written in whole batches.

A stream is any unbounded frame (spark.readStream). State is bounded by the watermark: what is later than
`late` no longer counts. Results of closed windows are appended once; a restart from the checkpoint repeats none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def binned_depth(loci: DataFrame, time: str, window: str, late: str, width: int) -> DataFrame:
    """(window, chrom, bin, n, bases): loci and their bases in each bin of positions that they touch, by window of time."""
    first, last = F.floor(F.col("s") / width), F.floor(F.col("e") / width)
    dealt = loci.filter("s <= e").withWatermark(time, late).select(time, "chrom", "s", "e", F.explode(F.sequence(first, last)).alias("bin"))
    inside = F.least(F.col("e"), (F.col("bin") + 1) * width - 1) - F.greatest(F.col("s"), F.col("bin") * width) + 1
    return dealt.groupBy(F.window(time, window), "chrom", "bin").agg(F.count("*").alias("n"), F.sum(inside).alias("bases"))


def first_seen(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def rolled_up(values: DataFrame, keys: list[str], time: str, window: str, late: str, measures: dict[str, Column], slide: str | None = None) -> DataFrame:
    """(window, keys, measures) by tumbling or, with slide, overlapping windows of time."""
    return values.withWatermark(time, late).groupBy(F.window(time, window, slide), *keys).agg(*(c.alias(n) for n, c in measures.items()))


def annotated(loci: DataFrame, features: DataFrame, width: int = 32) -> DataFrame:
    """Arriving loci with each feature of a table that they overlap; its columns get r_. No state is held.

    Both sides are dealt to bins; a pair is made in the first bin that both have.
    """
    deal = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    left = loci.filter("s <= e").select("*", deal("s", "e").alias("_bin"))
    right = features.filter("s <= e").select(*(F.col(c).alias(f"r_{c}") for c in features.columns)).select("*", deal("r_s", "r_e").alias("r_bin"))
    hit = (F.col("chrom") == F.col("r_chrom")) & (F.col("_bin") == F.col("r_bin")) & (F.col("s") <= F.col("r_e")) & (F.col("r_s") <= F.col("e"))
    return left.join(right, hit).filter(F.col("_bin") == F.floor(F.greatest("s", "r_s") / width)).drop("_bin", "r_bin", "r_chrom")


def appended(out: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start writing results as Parquet; once: what is there now, then stop."""
    w = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start(path)
