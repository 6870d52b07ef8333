"""Operators on counts of aligned reads: artefact reduction, library scaling, correlation of bins, enrichment."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .scans import haloed, running


def reduce_artefacts(df: DataFrame, keys: list[str], position: str, count: str, flank: int, threshold: int) -> DataFrame:
    """df with reduced: counts over the threshold cut to what their flanks let expect.

    A count over three times the mean m3 / 3 of the places within `flank` that have counts becomes m3 + sqrt(count - m3),
    without such places threshold + sqrt(count - threshold); others stay. Positions differ within the keys.
    """
    w = Window.partitionBy(*keys, "_block").orderBy(position).rangeBetween(-flank, flank)
    d = haloed(df.filter(F.col(count) > 0), position, flank)
    d = d.withColumns({"_sum": F.sum(count).over(w) - F.col(count), "_n": F.count(F.lit(1)).over(w) - 1}).filter("_own")
    own = F.col(count)
    triple = 3 * F.col("_sum") / F.col("_n")
    by_flank = F.when(own > F.floor(triple), F.floor(triple + F.sqrt(own - triple))).otherwise(own)
    cut = F.when(F.col("_n") > 0, by_flank).otherwise(F.floor(F.lit(threshold) + F.sqrt(own - threshold)))
    out = d.withColumn("reduced", F.when(own > threshold, cut).otherwise(own).cast("bigint")).drop("_sum", "_n", "_block", "_own")
    return out.unionByName(df.filter(F.coalesce(own <= 0, F.lit(True))).withColumn("reduced", own.cast("bigint")))


def scaled_counts(df: DataFrame, order: list[str], position: str, count: str, factor: Column) -> DataFrame:
    """df with scaled: counts times a factor as whole numbers; what rounding leaves is carried to the next row.

    So the first rows' scaled counts always add up to their scaled sum, rounded. factor: a column with one value.
    """
    d = running(df.withColumn("_all", F.lit(1)), ["_all"], order, position, {"_upto": ("sum", F.col(count))}, before=False)
    rounded = lambda x: F.floor(x * factor + 0.5)
    return d.withColumn("scaled", rounded(F.col("_upto")) - rounded(F.col("_upto") - F.col(count))).drop("_upto", "_all")


def library_scaled(df: DataFrame, library: str, order: list[str], position: str, count: str) -> DataFrame:
    """df with scaled: the smaller of two libraries (by sum of counts) scaled up to the larger one."""
    total = df.groupBy(library).agg(F.sum(count).alias("_t")).agg(F.max("_t").alias("_most"), F.min("_t").alias("_least"), F.min_by(library, F.struct("_t", library)).alias("_small"))
    d = df.join(F.broadcast(total))  # one row
    small = scaled_counts(d.filter(F.col(library) == F.col("_small")), order, position, count, F.col("_most") / F.col("_least"))
    rest = d.filter(F.col(library) != F.col("_small")).withColumn("scaled", F.col(count).cast("bigint"))
    return small.unionByName(rest).drop("_most", "_least", "_small")


def laplace_pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, r) over rows where either is at least 1.

    As the method has it, means are of the values plus one while deviations are of the values themselves, and
    sums of squares are at least 0.00001: not an ordinary correlation.
    """
    n = F.col("n")
    d = df.filter(F.greatest(x, y) >= 1).groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(v.cast("double")).alias(k) for k, v in {"sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "syy": F.col(y) * F.col(y), "sxy": F.col(x) * F.col(y)}.items()])
    mx, my = F.col("sx") / n + 1, F.col("sy") / n + 1
    num = F.col("sxy") - mx * F.col("sy") - my * F.col("sx") + n * mx * my
    of = lambda ss, s, m: F.greatest(F.col(ss) - 2 * m * F.col(s) + n * m * m, F.lit(0.00001))
    return d.select(*keys, "n", (num / F.sqrt(of("sxx", "sx", mx) * of("syy", "sy", my))).alias("r"))


def _pearson_of(x: np.ndarray, y: np.ndarray) -> float:
    some = (x >= 1) | (y >= 1)
    if not some.any():
        return 0.0
    x, y = x[some], y[some]
    a, b = x - (x + 1).mean(), y - (y + 1).mean()
    return float((a * b).sum() / math.sqrt(max((a * a).sum(), 1e-5) * max((b * b).sum(), 1e-5)))


def bootstrap_pearson(df: DataFrame, key: str, x: str, y: str, rounds: int = 200, seed: int = 1) -> DataFrame:
    """(key, r, low, median, high): the correlation of each key's bins and that of Poisson draws around its counts.

    A key is a feature with a bounded number of bins. The draws follow from the seed and the key's name.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[key].iloc[0]
        pdf = pdf.sort_values([x, y])
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
        draws = np.sort([_pearson_of(rng.poisson(a).astype(float), rng.poisson(b).astype(float)) for _ in range(rounds)])
        low, median, high = np.quantile(draws, [0.025, 0.5, 0.975])
        return pd.DataFrame({key: [name], "r": [_pearson_of(a, b)], "low": [low], "median": [median], "high": [high]})

    kind = dict(df.dtypes)[key]
    return df.select(key, x, y).groupBy(key).applyInPandas(one, f"{key} {kind}, r double, low double, median double, high double")


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of the table (a, b), (c, d); -1 where an expected count is below 5."""
    n = (a + b + c + d).cast("double")
    expected = [(p + q) * (p + r) / n for p, q, r in ((a, b, c), (b, a, d), (c, d, a), (d, c, b))]
    total = sum(((o - e) * (o - e) / e for o, e in zip((a, b, c, d), expected, strict=True)), F.lit(0.0))
    return F.when((n > 0) & (F.least(*expected) >= 5), total).otherwise(-1.0)


@F.pandas_udf(DoubleType())
def chi_square_p(q: pd.Series) -> pd.Series:
    """Chance of a chi-square of one degree of freedom as large; 2 for a negative one, which marks an error."""
    return pd.Series([2.0 if x < 0 else math.erfc(math.sqrt(x / 2)) for x in q], dtype=float)


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact chance of the table (a, b), (c, d): of all tables with its margins that are no likelier."""

    def one(a: int, b: int, c: int, d: int) -> float:
        row, column, n = a + b, a + c, a + b + c + d
        low, high = max(0, row + column - n), min(row, column)
        k = np.arange(low, high + 1)
        lg = np.vectorize(math.lgamma, otypes=[float])
        log = -(lg(k + 1) + lg(row - k + 1) + lg(column - k + 1) + lg(n - row - column + k + 1))
        log -= log.max()
        p = np.exp(log)
        return float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum() / p.sum()))

    return pd.Series([one(*map(int, r)) for r in zip(a, b, c, d, strict=True)], dtype=float)


def coalesced_starts(df: DataFrame, key: str, position: str, count: str, length: int) -> DataFrame:
    """(key, start, n): counts of starts summed at anchors.

    An anchor takes all starts less than `length` after it; the first start beyond is the next anchor. Where
    there is a gap of `length` an anchor must follow, so each stretch between gaps goes through on its own, row by row.
    """
    d = df.groupBy(key, position).agg(F.sum(count).alias("n"))
    d = running(d, [key], [position], position, {"_last": ("max", F.col(position))}, before=True)
    fresh = F.when(F.col("_last").isNull() | (F.col(position) - F.col("_last") >= length), 1).otherwise(0)
    d = running(d, [key], [position], position, {"_run": ("sum", fresh)}, before=False)

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list = []
        for pdf in batches:
            done = []
            for name, at, n in pdf.itertuples(index=False, name=None):
                if now and now[0] == name and at - now[1] < length:
                    now[2] += n
                    continue
                if now:
                    done.append(tuple(now))
                now = [name, at, n]
            if done:
                yield pd.DataFrame(done, columns=[key, "start", "n"])
        if now:
            yield pd.DataFrame([tuple(now)], columns=[key, "start", "n"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = d.repartition(parts, key, "_run").sortWithinPartitions(key, position).select(key, position, "n")
    return sent.mapInPandas(anchors, f"{key} {dict(df.dtypes)[key]}, start bigint, n bigint")
