"""Operators on tables: length statistics, top rows, pivots, correlation, corrections, alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import running, running_sum


def nxx(lengths: DataFrame, points: list[int]) -> DataFrame:
    """(nxx, length, n): the longest sequences, down to that length, hold at least nxx percent of all bases.

    Equal lengths are counted first: the running sum goes over distinct lengths.
    """
    by_length = lengths.filter("len > 0").groupBy("len").agg(F.count("*").alias("k"))
    d = by_length.withColumn("neg", -F.col("len")).withColumn("all", F.lit(1))
    d = running(d, ["all"], ["neg"], "neg", {"upto": ("sum", F.col("len") * F.col("k")), "n": ("sum", F.col("k"))}, before=False, totals=True).withColumnRenamed("all_upto", "total")
    d = d.withColumn("nxx", F.explode(F.array(*[F.lit(p) for p in points]))).filter(F.col("upto") * 100 >= F.col("total") * F.col("nxx"))
    return d.groupBy("nxx").agg(F.max("len").alias("length"), F.max_by("n", "len").alias("n"))


#: Characters of a piece in which k-mers are looked up by position.
PIECE = 128


def kmers(texts: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """keys and every k-mer of text, in place.

    A text is cut into pieces first, each with the k - 1 characters after it, so that work grows with the
    text's length and an exploded row carries a piece, not the text.
    """
    size = max(PIECE, k)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    d = texts.filter("text is not null").select(*keys, pieces.alias("pieces"))
    wide = F.transform("pieces", lambda x, i: F.concat(x, F.coalesce(F.left(F.get("pieces", i + 1), F.lit(k - 1)), F.lit(""))))
    d = d.select(*keys, F.explode(wide).alias("piece")).filter(F.char_length("piece") >= k)
    # The last piece may be part of what the one before has in full.
    last = F.least(F.char_length("piece") - k + 1, F.lit(size))
    return d.select(*keys, "piece", F.explode(F.sequence(F.lit(1), last)).alias("at")).select(*keys, F.substring(F.col("piece"), F.col("at"), F.lit(k)).alias("kmer"))


def kmer_counts(texts: DataFrame, k: int, keys: list[str]) -> DataFrame:
    return kmers(texts, k, keys).groupBy(*keys, "kmer").agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, half: int) -> DataFrame:
    """Integer mean of up to 2 half + 1 neighbours; windows are cut short at the ends."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn("smooth", F.floor(F.sum(value).over(w) / F.count(value).over(w)))


def corrected(p: DataFrame, method: str) -> DataFrame:
    """p (id, p) with adj: Bonferroni, Holm or Benjamini-Hochberg, each step by itself, capped at 1; ids are numbers.

    Ranks come from a running count over distinct p-values in cells, even ones above 1/64 and ones of a sixtieth
    of a power of e below, where p-values crowd; and, of equal p-values, over blocks of ids.
    """
    cell = F.when(F.col("p") >= 1 / 64, F.floor(F.col("p") * 65536) + (1 << 20)).otherwise(F.floor((F.log(F.greatest("p", F.lit(5e-324))) + 745) * 60))
    by_p = p.groupBy("p").agg(F.count("*").alias("k")).withColumn("all", F.lit(1))
    by_p = running(by_p, ["all"], ["p"], "p", {"before": ("sum", F.col("k"))}, before=True, cell=cell, totals=True)
    d = running_sum(p, ["p"], ["id"], "id", F.lit(1), "own", width=1 << 16)
    d = d.join(by_p.select("p", "before", F.col("all_before").alias("m")), "p").withColumn("r", F.col("before") + F.col("own"))
    factor = {"bonferroni": F.col("m"), "holm": F.col("m") - F.col("r") + 1, "bh": F.col("m") / F.col("r")}[method]
    return d.select("id", "p", F.least(F.col("p") * factor, F.lit(1.0)).alias("adj"))


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation from integer sums, null where a side is constant."""
    n, f = F.count("*"), lambda c: F.sum(c.cast("decimal(38,0)"))
    x, y = F.col(x), F.col(y)
    d = df.groupBy(*keys).agg(n.alias("n"), f(x).alias("sx"), f(y).alias("sy"), f(x * x).alias("sxx"), f(y * y).alias("syy"), f(x * y).alias("sxy"))
    c = {k: F.col(k).cast("double") for k in ("sx", "sy", "sxx", "syy", "sxy")}
    vx, vy = F.col("n") * c["sxx"] - c["sx"] * c["sx"], F.col("n") * c["syy"] - c["sy"] * c["sy"]
    return d.select(*keys, "n", F.round(F.when((vx > 0) & (vy > 0), (F.col("n") * c["sxy"] - c["sx"] * c["sy"]) / F.sqrt(vx) / F.sqrt(vy)), 6).alias("r"))


def spans(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Runs of equal value over neighbouring positions: keys, s, e, value."""
    w = Window.partitionBy(*keys).orderBy(position)
    new = F.when((F.lag(value).over(w) == F.col(value)) & (F.lag(position).over(w) == F.col(position) - 1), 0).otherwise(1)
    d = df.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return d.groupBy(*keys, "run", value).agg(F.min(position).alias("s"), F.max(position).alias("e")).drop("run")


def complement(base: Column) -> Column:
    return F.reverse(F.translate(base, "ACGTacgt", "TGCAtgca"))


def top_columns(df: DataFrame, least: float, most: int) -> DataFrame:
    """(col, support): the `most` columns of a matrix (row, col, value) with most values of at least `least`; of equals the first."""
    s = df.filter(F.col("value") >= least).groupBy("col").agg(F.count("*").alias("support"))
    return s.orderBy(F.desc("support"), "col").limit(most)


def column_sets(df: DataFrame, least: float, size: int, rows: int) -> DataFrame:
    """(items, support): sets of `size` columns in which at least `rows` rows reach `least` together.

    Sets grow by one column a step from those that are frequent, so few that aren't are counted; a row holds its frequent sets.
    """
    has = df.filter(F.col("value") >= least).select("row", "col").distinct()
    now = has.select("row", F.array("col").alias("items"))
    for n in range(1, size + 1):
        often = now.groupBy("items").agg(F.count("*").alias("support")).filter(F.col("support") >= rows)
        if n == size:
            return often
        kept = now.join(often.select("items"), "items")
        now = kept.join(has, "row").filter(F.col("col") > F.element_at("items", -1)).select("row", F.concat("items", F.array("col")).alias("items"))
    raise ValueError("size must be 1 at least")


def region_table(df: DataFrame, cls: str, region: str, regions: list, value: Column) -> DataFrame:
    """One row a class with the summed value of each region, 0 where there is none, and their percent of the class: r_<region>, p_<region>."""
    sums = [F.sum(F.when(F.col(region) == r, value).otherwise(0)).alias(f"r_{r}") for r in regions]
    d = df.groupBy(cls).agg(*sums, F.sum(value).alias("_all"))
    return d.select(cls, *[f"r_{r}" for r in regions], *[F.try_divide(100.0 * F.col(f"r_{r}"), F.col("_all")).alias(f"p_{r}") for r in regions])


def feature_depth(segments: DataFrame, features: DataFrame, depth: str) -> DataFrame:
    """(name, covered, total, mean): bases of each feature with any depth, their summed depth, and its mean over the feature."""
    from .intervals import overlap_join

    p = overlap_join(segments.select("chrom", "s", "e", depth), features.select("chrom", "s", "e", "name"))
    n = F.least("e", "r_e") - F.greatest("s", "r_s") + 1
    d = p.groupBy(F.col("r_name").alias("name"), "r_s", "r_e").agg(F.sum(n).alias("covered"), F.sum(n * F.col(depth)).alias("total"))
    return d.select("name", "covered", "total", (F.col("total") / (F.col("r_e") - F.col("r_s") + 1)).alias("mean"))


def feature_bins(loci: DataFrame, features: DataFrame, bins: int, sides: dict[str, Column]) -> DataFrame:
    """(name, bin, sides): starts of loci in the even parts of each feature, along its strand, counted by side."""
    from .intervals import overlap_join

    l = loci.select("chrom", "s", F.col("s").alias("e"), *[c.alias(f"_{n}") for n, c in sides.items()])
    p = overlap_join(l, features.select("chrom", "s", "e", "strand", "name"))
    at = F.when(F.col("r_strand") == "-", F.col("r_e") - F.col("s")).otherwise(F.col("s") - F.col("r_s"))
    bin_ = F.floor(at * bins / (F.col("r_e") - F.col("r_s") + 1))
    return p.groupBy(F.col("r_name").alias("name"), bin_.alias("bin")).agg(*[F.sum(F.col(f"_{n}").cast("int")).alias(n) for n in sides])


def bin_overlap(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, both, only_x, only_y): bins with counts on both sides, and on one only."""
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a, b = F.col(x) > 0, F.col(y) > 0
    return df.groupBy(*keys).agg(hit(a & b).alias("both"), hit(a & ~b).alias("only_x"), hit(~a & b).alias("only_y"))


def profile_agreement(counts: DataFrame, group: str, key: str, n: str) -> DataFrame:
    """(a, b, r): Pearson's correlation, over all keys that any group has, of every two groups' counts plus one. Groups are few."""
    g = counts.groupBy(group, key).agg(F.sum(n).cast("double").alias("v"))
    total = g.agg(F.count_distinct(key).alias("m"))
    one = g.groupBy(group).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    x, y = g.select(key, F.col(group).alias("a"), F.col("v").alias("va")), g.select(key, F.col(group).alias("b"), F.col("v").alias("vb"))
    xy = x.join(y, key).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("p"))
    d = xy.join(one.select(F.col(group).alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa")), "a").join(one.select(F.col(group).alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb")), "b").join(F.broadcast(total))
    # Adding one to every count moves no deviation.
    m = F.col("m")
    cov = F.col("p") - F.col("sa") * F.col("sb") / m
    return d.select("a", "b", (cov / F.sqrt((F.col("qa") - F.col("sa") * F.col("sa") / m) * (F.col("qb") - F.col("sb") * F.col("sb") / m))).alias("r"))
