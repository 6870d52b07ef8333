"""Interval operators on closed intervals [s, e] of a chromosome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import WIDTH, following, max_before, running


def merge_islands(df: DataFrame, keys: list[str], max_gap: int = 0, sums: dict[str, Column] | None = None, width: int = WIDTH) -> DataFrame:
    """Maximal unions of intervals whose gaps (start - end - 1) are at most max_gap: keys, s, e, n and the sums.

    Equal intervals are summed up first, so copies cost one row. An island begins where no interval before
    reaches; its end and sums are those before the next one's beginning.
    """
    sums = {"n": F.lit(1)} | (sums or {})
    d = df.groupBy(*keys, "s", "e").agg(*[F.sum(v).alias(f"_{n}") for n, v in sums.items()])
    folds = {"pe": ("max", F.col("e"))} | {n: ("sum", F.col(f"_{n}")) for n in sums}
    d = running(d, keys, ["s", "e"], "s", folds, before=True, width=width, totals=True)
    first = d.filter(F.col("pe").isNull() | (F.col("s") > F.col("pe") + 1 + max_gap)).drop("e")
    first = following(first, keys, "s", {"next_pe": "pe"} | {f"next_{n}": n for n in sums}, width=width)
    of = [(F.coalesce(f"next_{n}", f"all_{n}") - F.col(n)).alias(n) for n in sums]
    return first.select(*keys, "s", F.coalesce("next_pe", "all_pe").alias("e"), *of)


def depth_segments(df: DataFrame, keys: list[str], sides: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """Segments of constant depth: keys, s, e and a depth for each side; places without any depth are left out."""
    steps = F.array(*[F.struct(at.alias("p"), *[F.when(c, sign).otherwise(0).alias(n) for n, c in sides.items()]) for at, sign in ((F.col("s"), 1), (F.col("e") + 1, -1))])
    d = df.select(*keys, F.inline(steps)).groupBy(*keys, "p").agg(*[F.sum(n).alias(f"_{n}") for n in sides])
    d = running(d, keys, ["p"], "p", {n: ("sum", F.col(f"_{n}")) for n in sides}, before=False, width=width, next_position="q")
    return d.filter(" or ".join(f"{n} > 0" for n in sides)).select(*keys, F.col("p").alias("s"), (F.col("q") - 1).alias("e"), *sides)


SET_MODES = {
    "intersect": lambda a, b: (a > 0) & (b > 0),
    "ref_only": lambda a, b: (a > 0) & (b == 0),
    "rel_only": lambda a, b: (a == 0) & (b > 0),
    "union": lambda a, b: (a > 0) | (b > 0),
}


def set_operation(df: DataFrame, keys: list[str], ref: Column, rel: Column, mode: str) -> DataFrame:
    """Maximal stretches where the two sides stand as mode says; each side is the union of its intervals."""
    d = depth_segments(df, keys, {"a": ref, "b": rel}).filter(SET_MODES[mode](F.col("a"), F.col("b")))
    return merge_islands(d.select(*keys, "s", "e"), keys, 0).drop("n")


def neither(df: DataFrame, keys: list[str]) -> DataFrame:
    """The gaps between the islands of a chromosome."""
    d = following(merge_islands(df, keys, 0), keys, "s", {"next": "s"})
    return d.filter("next is not null").select(*keys, (F.col("e") + 1).alias("s"), (F.col("next") - 1).alias("e"))


#: Bits of position in a bin of each level: an interval lies in at most two bins of the least level that is as wide as it.
LEVELS = range(6, 34, 3)


def _level(s: Column, e: Column) -> Column:
    """The least level whose bins are as wide as an interval."""
    return F.coalesce(*[F.when(e - s < 1 << b, b) for b in LEVELS], F.lit(LEVELS[-1]))


def levels_of(df: DataFrame, s: Column, e: Column) -> set[int]:
    """The levels of df's intervals: one row for each of at most len(LEVELS)."""
    return {r[0] for r in df.select(_level(s, e)).distinct().collect()}


def overlap_join(left: DataFrame, right: DataFrame, flank: int = 0) -> DataFrame:
    """Pairs of intervals of one chromosome that overlap, right widened by flank; right's columns get r_.

    Both sides are dealt to bins of positions as wide as their intervals, or wider where the other side's
    are: a long interval costs no more rows than a short one. A pair is made at the wider one's level, in
    the first bin that both have there.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("rs", F.col("r_s") - flank).withColumn("re", F.col("r_e") + flank)
    here, there = levels_of(left, F.col("s"), F.col("e")), levels_of(r, F.col("rs"), F.col("re"))

    def dealt(df: DataFrame, s: str, e: str, own: set[int], other: set[int], to: str) -> DataFrame:
        """df with its intervals' own level, and a row for each level and bin that they are dealt to, with the first bin there."""
        every = sorted(own | other)
        at = [F.when((F.col(f"{to}own") <= b) if b in other else (F.col(f"{to}own") == b), b) for b in every]
        df = df.withColumn(f"{to}own", _level(F.col(s), F.col(e)))
        df = df.withColumn(f"{to}level", F.lit(every[0]) if len(every) == 1 else F.explode(F.array_compact(F.array(*at))))
        df = df.withColumn(f"{to}first", F.expr(f"shiftright({s}, {to}level)"))
        return df.withColumn(f"{to}bin", F.explode(F.sequence(f"{to}first", F.expr(f"shiftright({e}, {to}level)"))))

    if not here or not there:  # nothing meets nothing
        here, there = here or {LEVELS[0]}, there or {LEVELS[0]}
    l, r = dealt(left, "s", "e", here, there, "_l"), dealt(r, "rs", "re", there, here, "_r")
    meet = (F.col("chrom") == F.col("r_chrom")) & (F.col("_llevel") == F.col("_rlevel")) & (F.col("_lbin") == F.col("_rbin"))
    own = (F.col("_llevel") == F.col("_lown")) | (F.col("_rlevel") == F.col("_rown"))
    hit = meet & own & (F.col("s") <= F.col("re")) & (F.col("e") >= F.col("rs")) & (F.col("_lbin") == F.greatest("_lfirst", "_rfirst"))
    return l.join(r, hit).drop("rs", "re", *[f"_{x}{n}" for x in "lr" for n in ("own", "level", "first", "bin")])


def overlap_any(left: DataFrame, right: DataFrame, anti: bool = False, width: int = WIDTH) -> DataFrame:
    """Left rows with (or, anti, without) an overlap.

    One scan: of the right intervals that start by a left one's end, the furthest end reaches its start or not.
    """
    row = F.struct(*left.columns)
    both = left.select("chrom", F.col("e").alias("p"), F.lit(1).alias("kind"), row.alias("row"), F.lit(None).cast("long").alias("end"))
    ends = right.groupBy("chrom", F.col("s").alias("p")).agg(F.max("e").alias("end"))
    both = both.unionByName(ends.select("chrom", "p", F.lit(0).alias("kind"), "end"), allowMissingColumns=True)
    both = running(both, ["chrom"], ["p", "kind"], "p", {"far": ("max", F.col("end"))}, before=False, width=width).filter("kind = 1")
    hit = F.coalesce(F.col("far") >= F.col("row.s"), F.lit(False))
    return both.filter(~hit if anti else hit).select("row.*")


def nearest_upstream(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with dist: bases between its start and the last right end before it; null without one."""
    return _as_of(left, right, "s", "e", True)


def nearest_downstream(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with dist: bases between its end and the first right start after it; null without one."""
    return _as_of(left, right, "e", "s", False)


def _as_of(left: DataFrame, right: DataFrame, at: str, other: str, before: bool) -> DataFrame:
    ends = right.select("chrom", F.col(other).alias("p")).distinct()
    points = left.select("chrom", F.col(at).alias("p")).distinct()
    both = ends.withColumn("kind", F.lit(1)).unionByName(points.withColumn("kind", F.lit(0)))
    sign = 1 if before else -1  # a scan over positions, or over positions backwards
    both = both.withColumn("q", F.col("p") * sign)
    both = both.withColumn("v", F.when(F.col("kind") == 1, F.col("q")))
    both = max_before(both, ["chrom"], ["q", "kind"], "q", F.col("v"), "found")
    found = both.filter("kind = 0").select("chrom", F.col("p").alias(at), (F.col("q") - F.col("found") - 1).alias("dist"))
    return left.join(found, ["chrom", at], "left")


#: Bits of the regions around a feature (fixed values): inside, upstream, downstream.
CDS, UPSTREAM, DOWNSTREAM = 1, 16, 32


def region_bits(left: DataFrame, right: DataFrame, flank: int, keep: list[str] = ()) -> DataFrame:
    """(src, bits): which regions of any feature each locus touches; 0 for none."""
    pairs = overlap_join(left.select("chrom", "s", "e", "src"), right.select("chrom", "s", "e").distinct(), flank=flank)
    bits = F.when((F.col("s") <= F.col("r_e")) & (F.col("e") >= F.col("r_s")), CDS).otherwise(0)
    bits = bits.bitwiseOR(F.when(F.col("s") < F.col("r_s"), UPSTREAM).otherwise(0)).bitwiseOR(F.when(F.col("e") > F.col("r_e"), DOWNSTREAM).otherwise(0))
    found = pairs.select("src", bits.alias("b")).groupBy("src").agg(F.bit_or("b").alias("b"))
    return left.select("src", *keep).join(found, "src", "left").select("src", F.coalesce("b", F.lit(0)).cast("int").alias("bits"), *keep)
