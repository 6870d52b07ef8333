"""Operators on ordered values: means, steps, runs, gaps in calls. A series is the rows of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Series shorter than this are not smoothed; narrowest and widest window.
LEAST, NARROW, WIDE = 10, 5, 8196


def whole(total: str, n: str) -> Column:
    """Integer division toward zero."""
    return F.expr(f"{total} div {n}")


def window_mean(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str) -> DataFrame:
    """df with out, the integer mean of the window of `width` rows around each, cut short at the ends.

    The window has width - width // 2 rows before and width // 2 - 1 after. A series shorter than the window
    has a window of its own length, one shorter than LEAST keeps its values.
    """
    width = min(max(width, NARROW), WIDE)
    per_key = Window.partitionBy(*keys)
    ordered = per_key.orderBy(*order)
    frame = ordered.rowsBetween(-(width - width // 2), width // 2 - 1)
    df = df.withColumns({"_n": F.count(F.lit(1)).over(per_key), "_at": F.row_number().over(ordered), "_upto": F.sum(value).over(ordered), "_all": F.sum(value).over(per_key)})
    df = df.withColumns({"_sum": F.sum(value).over(frame), "_count": F.count(F.lit(1)).over(frame)})
    # A short series: a window of n reaches one of its ends, so its sum takes one other row's running sum.
    half = F.expr("_n - _n div 2")
    early = F.col("_at") <= half
    df = df.withColumn("_look", F.when(F.col("_n") < width, F.when(early, F.least(F.col("_n"), F.col("_at") + F.expr("_n div 2") - 1)).otherwise(F.col("_at") - half - 1)))
    sums = df.filter(F.col("_n") < width).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_at").alias("_other"), F.col("_upto").alias("_there"))
    same = F.col("_look") == F.col("_other")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    df = df.join(sums, same, "left").withColumn("_there", F.coalesce("_there", F.lit(0)))
    df = df.withColumns({"_short": F.when(early, F.col("_there")).otherwise(F.col("_all") - F.col("_there")), "_size": F.when(early, F.col("_look")).otherwise(F.col("_n") - F.col("_look"))})
    mean = F.when(F.col("_n") < LEAST, F.col(value)).when(F.col("_n") < width, whole("_short", "_size")).otherwise(whole("_sum", "_count"))
    return df.withColumn(out, mean).drop("_n", "_at", "_upto", "_all", "_sum", "_count", "_look", "_other", "_there", "_short", "_size", *[f"_k_{k}" for k in keys])


def above_baseline(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str) -> DataFrame:
    """df with out: how far the value stands above its window's mean, 0 if it doesn't; short series keep their values."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = window_mean(df, keys, order, value, width, "_base")
    return df.withColumn(out, F.when(n < LEAST, F.col(value)).otherwise(F.greatest(F.col(value) - F.col("_base"), F.lit(0)))).drop("_base")


def smooth_steps(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str) -> DataFrame:
    """df with out: the first value and the sum of all later steps, the n-th divided by n or at most by width.

    A series shorter than the window keeps its values.
    """
    width = min(width, 100)
    ordered = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_by", F.least(F.row_number().over(ordered), F.lit(width))).withColumn("_step", F.col(value) - F.lag(value).over(ordered))
    df = df.withColumn("_part", F.coalesce(whole("_step", "_by"), F.col(value))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return df.withColumn(out, F.when(F.col("_n") < width, F.col(value)).otherwise(F.sum("_part").over(ordered))).drop("_by", "_step", "_part", "_n")


def half_neighbours(df: DataFrame, keys: list[str], bin_: str, value: str, out: str) -> DataFrame:
    """df with out: each bin's value and half of those of the bins beside it, rounded down; missing bins hold 0."""
    ordered = Window.partitionBy(*keys).orderBy(bin_)
    beside = lambda f, d: F.coalesce(F.when(f(bin_).over(ordered) == F.col(bin_) + d, F.shiftright(f(value).over(ordered), 1)), F.lit(0))
    return df.withColumn(out, F.col(value) + beside(F.lag, -1) + beside(F.lead, 1))


def trim_runs(df: DataFrame, keys: list[str], position: str, head: int, tail: int) -> DataFrame:
    """The rows of each run of neighbouring positions without its first `head` and last `tail`; positions are distinct."""
    ordered = Window.partitionBy(*keys).orderBy(position)
    d = df.withColumn("_run", F.col(position) - F.row_number().over(ordered))
    run = d.groupBy(*keys, "_run").agg(F.min(position).alias("_s"), F.max(position).alias("_e")).filter(F.col("_e") - F.col("_s") >= head + tail)
    inside = (F.col(position) >= F.col("_s") + head) & (F.col(position) <= F.col("_e") - tail)
    return d.join(run, [*keys, "_run"]).filter(inside).drop("_run", "_s", "_e")


def filled_calls(df: DataFrame, keys: list[str], bin_: str, call: str, out: str) -> DataFrame:
    """df with out: the call, or where it is null that of the row beside it; odd bins look left first, even ones right."""
    ordered = Window.partitionBy(*keys).orderBy(bin_)
    left, right = F.lag(call).over(ordered), F.lead(call).over(ordered)
    return df.withColumn(out, F.coalesce(call, F.when(F.col(bin_) % 2 != 0, F.coalesce(left, right)).otherwise(F.coalesce(right, left))))


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], position: str, reach: int) -> DataFrame:
    """Pairs of rows of the same keys no further than `reach` apart; right's other columns get r_, and distance is right's place less left's."""
    width = max(reach, 1)
    l = left.withColumn("_bin", F.floor(F.col(position) / width))
    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    r = r.withColumn("_at", F.floor(F.col(f"r_{position}") / width)).withColumn("_bin", F.explode(F.sequence(F.col("_at") - 1, F.col("_at") + 1))).drop("_at")
    distance = F.col(f"r_{position}") - F.col(position)
    return l.join(r, [*keys, "_bin"]).withColumn("distance", distance).filter(F.abs("distance") <= reach).drop("_bin")


def matched_points(left: DataFrame, right: DataFrame, key: str, position: str, reach: int) -> DataFrame:
    """(key, a, b) of a one-to-one match of two sets of points: in order, each with the first free one no further than `reach`.

    Where there is a gap of more than `reach` no match can cross, so each stretch between gaps goes through on its own.
    """
    from collections import deque

    import pandas as pd

    from .scans import running

    both = left.select(key, position, F.lit(0).alias("side")).unionByName(right.select(key, position, F.lit(1).alias("side")))
    c = both.groupBy(key, position, "side").agg(F.count("*").alias("n"))
    c = running(c, [key], [position, "side"], position, {"_last": ("max", F.col(position))}, before=True)
    c = running(c, [key], [position, "side"], position, {"_run": ("sum", F.when(F.col("_last").isNull() | (F.col(position) - F.col("_last") > reach), 1).otherwise(0))}, before=False)

    def match(batches):
        name, waiting = None, (deque(), deque())
        for pdf in batches:
            rows = []
            for k, at, side, n in pdf.itertuples(index=False, name=None):
                if k != name:
                    name, waiting = k, (deque(), deque())
                for _ in range(n):
                    other = waiting[1 - side]
                    while other and other[0] < at - reach:
                        other.popleft()
                    if other:
                        p = other.popleft()
                        rows.append((k, at, p) if side == 0 else (k, p, at))
                    else:
                        waiting[side].append(at)
            if rows:
                yield pd.DataFrame(rows, columns=[key, "a", "b"])

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = c.repartition(parts, key, "_run").sortWithinPartitions(key, position, "side").select(key, position, "side", "n")
    return sent.mapInPandas(match, f"{key} {dict(left.dtypes)[key]}, a bigint, b bigint")
