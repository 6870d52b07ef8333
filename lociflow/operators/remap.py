"""Coordinates from one sequence to another, and bases put in place: mapped blocks, sites, covered segments, ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .intervals import merge_islands, overlap_join
from .scans import haloed


def remapped(loci: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, to_chrom, to_s, to_e, strand) of the parts of loci that lie in mapped blocks.

    blocks: chrom, s, e, to_chrom, to_s, strand. A locus over several blocks comes in as many parts; on the minus strand
    a block's first base is its image's last.
    """
    p = overlap_join(loci.select("src", "chrom", "s", "e"), blocks.select("chrom", "s", "e", "to_chrom", "to_s", "strand"))
    a, b = F.greatest("s", "r_s"), F.least("e", "r_e")
    minus = F.col("r_strand") == "-"
    to_s = F.when(minus, F.col("r_to_s") + F.col("r_e") - b).otherwise(F.col("r_to_s") + a - F.col("r_s"))
    return p.select("src", F.col("r_to_chrom").alias("to_chrom"), to_s.alias("to_s"), (to_s + b - a).alias("to_e"), F.col("r_strand").alias("strand"))


def remapped_ends(loci: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, to_chrom, to_s, to_e, bases) of loci as a whole: from the first to the last mapped base on one chromosome, with how many are mapped."""
    parts = remapped(loci, blocks)
    return parts.groupBy("src", "to_chrom").agg(F.min("to_s").alias("to_s"), F.max("to_e").alias("to_e"), F.sum(F.col("to_e") - F.col("to_s") + 1).alias("bases"))


def slices(loci: DataFrame, seqs: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """loci with seq: their bases and flanks, cut at the sequence's ends, on the locus' own strand. seqs: chrom, seq."""
    d = loci.join(seqs.select("chrom", "seq"), "chrom")
    minus = F.col("strand") == "-" if "strand" in loci.columns else F.lit(False)
    left, right = (F.when(minus, F.lit(x)).otherwise(F.lit(y)) for x, y in ((after, before), (before, after)))
    a = F.greatest(F.col("s") - left, F.lit(0))
    piece = F.substring(F.col("seq"), (a + 1).cast("int"), (F.col("e") + right - a + 1).cast("int"))
    return d.withColumn("seq", F.when(minus, reverse_complement(piece)).otherwise(piece))


def pieces(seqs: DataFrame, width: int) -> DataFrame:
    """(chrom, s, seq): sequences in pieces of `width`, each with its place."""
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    return seqs.select("chrom", F.posexplode(cut).alias("n", "seq")).select("chrom", (F.col("n").cast("bigint") * width).alias("s"), "seq")


def with_sites(seqs: DataFrame, sites: DataFrame, width: int = 1000) -> DataFrame:
    """Sequences in pieces with bases overwritten at sites (chrom, at, base); of several at one place the smallest base."""
    p = pieces(seqs, width).withColumn("n", F.floor(F.col("s") / width))
    one = sites.groupBy("chrom", "at").agg(F.min("base").alias("base"))
    here = one.groupBy("chrom", F.floor(F.col("at") / width).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("at") % width).cast("int").alias("i"), "base"))).alias("to"))
    each = F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c, i: F.coalesce(F.col("to")[i], c))
    return p.join(here, ["chrom", "n"], "left").withColumn("seq", F.when(F.col("to").isNull(), F.col("seq")).otherwise(F.array_join(each, ""))).select("chrom", "s", "seq")


def masked(seqs: DataFrame, covered: DataFrame, width: int = 1000, mask: str = "N") -> DataFrame:
    """Sequences in pieces with every base outside the covered segments (chrom, s, e) masked."""
    p = pieces(seqs, width).withColumn("e", F.col("s") + F.char_length("seq") - 1)
    seg = merge_islands(covered, ["chrom"], 0).drop("n")
    hit = overlap_join(p.select("chrom", "s", "e"), seg)
    at = hit.groupBy("chrom", "s").agg(F.array_sort(F.collect_list(F.struct((F.greatest("s", "r_s") - F.col("s")).cast("int").alias("a"), (F.least("e", "r_e") - F.col("s")).cast("int").alias("b")))).alias("on"))
    each = F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c, i: F.when(F.exists("on", lambda x: (x["a"] <= i) & (i <= x["b"])), c).otherwise(mask))
    return p.join(at, ["chrom", "s"], "left").withColumn("seq", F.when(F.col("on").isNull(), F.repeat(F.lit(mask), F.char_length("seq"))).otherwise(F.array_join(each, ""))).select("chrom", "s", "seq")


def base_scores(aligned: DataFrame, truth: DataFrame, beta: float = 1.0) -> DataFrame:
    """(reads, tp, fp, fn, precision, recall, f) of alignments (read, chrom, s, e) against the places reads came from: bases in both, in the alignment only, in the truth only."""
    t = truth.select("read", F.col("chrom").alias("t_chrom"), F.col("s").alias("t_s"), F.col("e").alias("t_e"))
    d = t.join(aligned.select("read", "chrom", "s", "e"), "read", "left")
    both = F.when(F.col("chrom") == F.col("t_chrom"), F.greatest(F.least("e", "t_e") - F.greatest("s", "t_s") + 1, F.lit(0))).otherwise(0)
    size, whole = F.coalesce(F.col("e") - F.col("s") + 1, F.lit(0)), F.col("t_e") - F.col("t_s") + 1
    a = d.agg(F.count_distinct("read").alias("reads"), F.sum(F.coalesce(both, F.lit(0))).alias("tp"), F.sum(size - F.coalesce(both, F.lit(0))).alias("fp"), F.sum(whole - F.coalesce(both, F.lit(0))).alias("fn"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    b = beta * beta
    return a.withColumns({"precision": p, "recall": r}).withColumn("f", F.try_divide((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")))


def local_peaks(df: DataFrame, keys: list[str], position: str, score: str, reach: int, least: float) -> DataFrame:
    """Rows of at least `least` whose score no row within `reach` exceeds; of equals within reach the first."""
    d = haloed(df, position, reach)
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys, "_block").orderBy(position)
    top = F.max(score).over(w.rangeBetween(-reach, reach))
    before = F.max(score).over(w.rangeBetween(-reach, -1))
    peak = (F.col(score) >= least) & (F.col(score) == F.col("_top")) & (F.col("_before").isNull() | (F.col("_before") < F.col(score)))
    return d.withColumns({"_top": top, "_before": before}).filter(F.col("_own") & peak).drop("_top", "_before", "_block", "_own")


def scaled_profile(loci: DataFrame, features: DataFrame, bins: int) -> DataFrame:
    """(name, bin, n): starts of loci inside each feature by its bins, which are `bins` even parts of its length along its strand."""
    p = overlap_join(loci.select("chrom", "s", F.col("s").alias("e")), features.select("chrom", "s", "e", "strand", "name"))
    size = F.col("r_e") - F.col("r_s") + 1
    at = F.when(F.col("r_strand") == "-", F.col("r_e") - F.col("s")).otherwise(F.col("s") - F.col("r_s"))
    return p.groupBy(F.col("r_name").alias("name"), F.floor(at * bins / size).alias("bin")).agg(F.count("*").alias("n"))


def window_density(loci: DataFrame, width: int) -> DataFrame:
    """(chrom, win, n, bases): elements that start in each window, and the bases of it that any element covers."""
    n = loci.groupBy("chrom", F.floor(F.col("s") / width).alias("win")).agg(F.count("*").alias("n"))
    isl = merge_islands(loci, ["chrom"], 0)
    part = isl.select("chrom", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))).alias("win"))
    bases = part.groupBy("chrom", "win").agg(F.sum(F.least("e", (F.col("win") + 1) * width - 1) - F.greatest("s", F.col("win") * width) + 1).alias("bases"))
    return bases.join(n, ["chrom", "win"], "left").select("chrom", "win", F.coalesce("n", F.lit(0)).alias("n"), "bases")


def hit_density(hits: DataFrame, width: int) -> DataFrame:
    """(chrom, bins, mean, deviation, cov): hits per bin of each chromosome; one bin deviates by 0, and cov is 100 where the mean isn't above 0.

    Bins run from 0 to the chromosome's last hit, those without hits count as 0.
    """
    b = hits.groupBy("chrom", F.floor(F.col("at") / width).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    s = b.groupBy("chrom").agg((F.max("bin") + 1).alias("bins"), F.sum("n").alias("sx"), F.sum(F.col("n") * F.col("n")).alias("sxx"))
    mean = F.col("sx") / F.col("bins")
    var = F.when(F.col("bins") > 1, F.greatest((F.col("sxx") - F.col("sx") * mean) / (F.col("bins") - 1), F.lit(0.0))).otherwise(0.0)
    return s.select("chrom", "bins", mean.alias("mean"), F.sqrt(var).alias("deviation"), F.when(mean > 0, 100 * F.sqrt(var) / mean).otherwise(100.0).alias("cov"))


def column_identity(rows: DataFrame) -> DataFrame:
    """(block, columns, aligned, identical) of alignment blocks (block, src, seq): columns, those without gaps, and those of one base in all."""
    c = rows.select("block", F.posexplode(F.filter(F.split(F.upper("seq"), ""), lambda x: x != "")).alias("at", "base"))
    per = c.groupBy("block", "at").agg(F.max((F.col("base") == "-").cast("int")).alias("gap"), F.min("base").alias("lo"), F.max("base").alias("hi"))
    full = F.col("gap") == 0
    return per.groupBy("block").agg(F.count("*").alias("columns"), F.sum(full.cast("int")).alias("aligned"), F.sum((full & (F.col("lo") == F.col("hi"))).cast("int")).alias("identical"))


def gapless_parts(rows: DataFrame, least: int) -> DataFrame:
    """(block, s, e): runs of columns, from 0 and closed, in which no row has a gap, of at least `least` columns."""
    from pyspark.sql.window import Window

    c = rows.select("block", F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("at", "base"))
    per = c.groupBy("block", "at").agg(F.max((F.col("base") == "-").cast("int")).alias("gap")).filter("gap = 0")
    run = F.col("at") - F.row_number().over(Window.partitionBy("block").orderBy("at"))
    return per.withColumn("_run", run).groupBy("block", "_run").agg(F.min("at").alias("s"), F.max("at").alias("e")).filter(F.col("e") - F.col("s") + 1 >= least).drop("_run")


def conserved_runs(rows: DataFrame, most: int, least: int) -> DataFrame:
    """(block, s, e): for each start the longest run of gapless columns with at most `most` mismatch columns, begun and ended by identical ones, not held in another; of at least `least` columns."""
    from pyspark.sql.window import Window

    c = rows.select("block", F.posexplode(F.filter(F.split(F.upper("seq"), ""), lambda x: x != "")).alias("at", "base"))
    per = c.groupBy("block", "at").agg(F.max((F.col("base") == "-").cast("int")).alias("gap"), (F.min("base") != F.max("base")).cast("int").alias("bad")).filter("gap = 0")
    run = F.col("at") - F.row_number().over(Window.partitionBy("block").orderBy("at"))
    per = per.withColumn("_run", run).withColumn("_bad", F.sum("bad").over(Window.partitionBy("block", "_run").orderBy("at")))
    good = per.filter("bad = 0")
    span = F.max("at").over(Window.partitionBy("block", "_run").orderBy("_bad").rangeBetween(0, most))
    d = good.withColumn("_e", span).groupBy("block", "_run", F.col("_e").alias("e")).agg(F.min("at").alias("s"))
    return d.filter(F.col("e") - F.col("s") + 1 >= least).select("block", "s", "e")


def lookup_along(index: DataFrame, values: DataFrame, default: float) -> DataFrame:
    """A k-mer index (id, at, kmer) with the value of each k-mer in a table (kmer, value), default where it has none."""
    return index.join(values, "kmer", "left").withColumn("value", F.coalesce("value", F.lit(default)))


def site_preference(starts: DataFrame, background: DataFrame) -> DataFrame:
    """(kmer, observed, expected, ratio): how often reads start at each k-mer against its share of the sequence. Both: kmer, n."""
    o, e = starts.groupBy("kmer").agg(F.sum("n").alias("o")), background.groupBy("kmer").agg(F.sum("n").alias("b"))
    total = lambda d, c: d.agg(F.sum(c)).first()[0] or 0  # noqa: E731  one number
    so, sb = total(o, "o"), total(e, "b")
    d = e.join(o, "kmer", "left").withColumn("o", F.coalesce("o", F.lit(0)))
    expected = F.col("b") * (so / sb if sb else 0.0)
    return d.select("kmer", F.col("o").alias("observed"), expected.alias("expected"), F.try_divide(F.col("o").cast("double"), expected).alias("ratio"))
