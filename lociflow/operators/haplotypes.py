"""Alleles of samples at loci: consensus of groups, markers of groups, scores of pairs, filling of gaps.

Calls are rows (chrom, locus, sample, allele), with allele null where a sample isn't covered. Groups are rows (sample, grp).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import haloed

#: Consensus of a group that is too small, and of one without a clear majority.
SMALL, MIXED = 0xFE, 0xFF


def modal_allele(calls: DataFrame, keys: list[str], order: str = "sample") -> DataFrame:
    """(keys, allele, n): the most frequent allele; of equals the one whose last needed sample comes first in order.

    That is the allele that reaches the winning count first when samples are read in order.
    """
    nth = F.row_number().over(Window.partitionBy(*keys, "allele").orderBy(order))
    c = calls.filter("allele is not null").withColumn("_nth", nth)
    best = c.groupBy(*keys, "allele").agg(F.count("*").alias("n"), F.max(F.struct("_nth", order)).alias("_last"))
    top = best.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(f"_last.{order}").alias("o"), "allele")).alias("_b"))
    return top.select(*keys, F.col("_b.allele").alias("allele"), (-F.col("_b.k")).alias("n"))


def group_consensus(calls: DataFrame, groups: DataFrame, least: int, share: float) -> DataFrame:
    """(chrom, locus, grp, allele): the modal allele of each group's samples; SMALL or MIXED where there is none to tell.

    A group needs `least` covered samples, and its mode `share` of them. Of equals the largest allele stands.
    """
    per = calls.filter("allele is not null").join(groups, "sample").groupBy("chrom", "locus", "grp", "allele").agg(F.count("*").alias("n"))
    g = per.groupBy("chrom", "locus", "grp").agg(F.sum("n").alias("covered"), F.max(F.struct("n", "allele")).alias("m"))
    allele = F.when(F.col("covered") < least, SMALL).when(F.col("m.n") < share * F.col("covered"), MIXED).otherwise(F.col("m.allele"))
    return g.select("chrom", "locus", "grp", allele.cast("int").alias("allele"))


def group_markers(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """(chrom, locus, grp, allele, tp, fp, fn, precision, recall, f): how well an allele tells a group's samples from the others.

    tp: the group's samples with the allele; fp: others with it; fn: the group's samples without it, covered or not.
    """
    size = groups.groupBy("grp").agg(F.count("*").alias("size"))
    per = calls.filter("allele is not null").join(groups, "sample").groupBy("chrom", "locus", "grp", "allele").agg(F.count("*").alias("tp"))
    all_ = per.groupBy("chrom", "locus", "allele").agg(F.sum("tp").alias("_with"))
    d = per.join(all_, ["chrom", "locus", "allele"]).join(size, "grp")
    d = d.withColumns({"fp": F.col("_with") - F.col("tp"), "fn": F.col("size") - F.col("tp")})
    d = d.withColumns({"precision": F.col("tp") / F.col("_with"), "recall": F.col("tp") / F.col("size")})
    return d.select("chrom", "locus", "grp", "allele", "tp", "fp", "fn", "precision", "recall", (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).alias("f"))


def pair_scores(calls: DataFrame, width: int) -> DataFrame:
    """(chrom, bin, a, b, both, same): for every two samples, the loci of a bin where both are covered and where they agree.

    Samples are few beside loci; a locus holds one call of each, so its pairs are bounded by the samples.
    """
    c = calls.filter("allele is not null").select("chrom", "locus", "sample", "allele")
    x, y = c.select("chrom", "locus", F.col("sample").alias("a"), F.col("allele").alias("p")), c.select("chrom", "locus", F.col("sample").alias("b"), F.col("allele").alias("q"))
    pairs = x.join(y, ["chrom", "locus"]).filter("a < b")
    return pairs.groupBy("chrom", F.floor(F.col("locus") / width).alias("bin"), "a", "b").agg(F.count("*").alias("both"), F.sum((F.col("p") == F.col("q")).cast("int")).alias("same"))


def concordance(calls: DataFrame, n_samples: int) -> DataFrame:
    """(chrom, loci, full, half, same, alike): loci, those that all or at least half of the samples cover, and of the full ones those where all agree or at least half do."""
    per = calls.groupBy("chrom", "locus", "allele").agg(F.count("*").alias("n"))
    covered = F.sum(F.when(F.col("allele").isNotNull(), F.col("n")).otherwise(0))
    at = per.groupBy("chrom", "locus").agg(covered.alias("c"), F.max(F.when(F.col("allele").isNotNull(), F.col("n"))).alias("m"))
    hits = lambda x: F.sum(F.when(x, 1).otherwise(0))
    full = F.col("c") == n_samples
    return at.groupBy("chrom").agg(F.count("*").alias("loci"), hits(full).alias("full"), hits(2 * F.col("c") >= n_samples).alias("half"), hits(full & (F.col("m") == n_samples)).alias("same"), hits(full & (2 * F.col("m") >= n_samples)).alias("alike"))


def window_majority(calls: DataFrame, reach: int, share: float) -> DataFrame:
    """calls with filled: the allele that has `share` of the sample's covered loci within `reach`, if there is one, else its own.

    Fills gaps and replaces outliers. Of equals the smallest allele counts.
    """
    d = haloed(calls, "locus", reach)
    near = d.select("chrom", "sample", "_block", F.col("locus").alias("_at"), F.col("allele").alias("_a")).filter("_a is not null")
    own = d.filter("_own").select("chrom", "sample", "_block", "locus", "allele")
    pairs = own.join(near, ["chrom", "sample", "_block"]).filter(F.abs(F.col("_at") - F.col("locus")) <= reach)
    n = pairs.groupBy("chrom", "sample", "locus", "_a").agg(F.count("*").alias("n"))
    top = n.groupBy("chrom", "sample", "locus").agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("k"), "_a")).alias("m"))
    clear = top.filter(-F.col("m.k") >= share * F.col("all")).select("chrom", "sample", "locus", F.col("m._a").alias("_filled"))
    return calls.join(clear, ["chrom", "sample", "locus"], "left").withColumn("filled", F.coalesce("_filled", "allele")).drop("_filled")


def best_founders(scores: DataFrame, most: int) -> DataFrame:
    """The rows of scores (progeny, founder, score) of each progeny's `most` best founders; ties fall to the first name."""
    w = Window.partitionBy("progeny").orderBy(F.desc("score"), "founder")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def binned_segments(reads: DataFrame, width: int) -> DataFrame:
    """(chrom, founder, bin, n): reads by founder and bin of their start. reads: chrom, founder, s."""
    return reads.groupBy("chrom", "founder", F.floor(F.col("s") / width).alias("bin")).agg(F.count("*").alias("n"))


def called_segments(bins: DataFrame, least: int, share: float) -> DataFrame:
    """(chrom, s, e, founder): neighbouring bins with one call as one. A bin is called for the founder with at least `least` reads and `share` of the bin's."""
    top = bins.groupBy("chrom", "bin").agg(F.sum("n").alias("all"), F.max(F.struct("n", "founder")).alias("m"))
    called = top.filter((F.col("m.n") >= least) & (F.col("m.n") >= share * F.col("all"))).select("chrom", "bin", F.col("m.founder").alias("founder"))
    run = F.col("bin") - F.row_number().over(Window.partitionBy("chrom", "founder").orderBy("bin"))
    return called.withColumn("_run", run).groupBy("chrom", "founder", "_run").agg(F.min("bin").alias("s"), F.max("bin").alias("e")).drop("_run")


def specific_alleles(counts: DataFrame, least: int, share: float, other_most: int) -> DataFrame:
    """(chrom, locus, species, base): the most frequent base of a species that tells it from all others there.

    It has at least `least` reads and, with one more, `share` of the species' reads, while every other species has
    fewer than other_most reads of it. counts: chrom, locus, species, base, n.
    """
    c = counts.groupBy("chrom", "locus", "species", "base").agg(F.sum("n").alias("n"))
    per = c.groupBy("chrom", "locus", "species").agg(F.sum("n").alias("all"), F.max(F.struct("n", "base")).alias("m"))
    major = per.filter((F.col("m.n") >= least) & ((F.col("m.n") + 1) / F.col("all") >= share)).select("chrom", "locus", "species", F.col("m.base").alias("base"))
    other = c.filter(F.col("n") >= other_most).select("chrom", "locus", "base", F.col("species").alias("_other"))
    same = [F.col(f"m.{k}") == F.col(f"o.{k}") for k in ("chrom", "locus", "base")]
    return major.alias("m").join(other.alias("o"), [*same, F.col("species") != F.col("_other")], "left_anti")


def shared_sites(sites: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard) of every two readsets that share a site. sites: readset, chrom, locus."""
    s = sites.select("readset", "chrom", "locus").distinct()
    n = s.groupBy("readset").agg(F.count("*").alias("n"))
    x, y = (s.withColumnRenamed("readset", k) for k in "ab")
    pairs = x.join(y, ["chrom", "locus"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = pairs.join(n.select(F.col("readset").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("readset").alias("b"), F.col("n").alias("nb")), "b")
    return pairs.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def homozygosity(calls: DataFrame, width: int) -> DataFrame:
    """(chrom, bin, a, b, score): the share of a bin's loci covered in both samples where their alleles are equal."""
    return pair_scores(calls, width).select("chrom", "bin", "a", "b", (F.col("same") / F.col("both")).alias("score"))


def difference_counts(calls: DataFrame, width: int) -> DataFrame:
    """(chrom, bin, a, b, diffs, both): for every two samples, a before b, the loci of a bin where their alleles differ and those where both are covered."""
    p = pair_scores(calls, width)
    return p.select("chrom", "bin", "a", "b", (F.col("both") - F.col("same")).alias("diffs"), "both")


def grouped_samples(differences: DataFrame, samples: DataFrame, distance: int) -> DataFrame:
    """(chrom, bin, sample, grp): groups of samples in each bin, the largest first.

    Again and again the sample with most others within `distance` differences, of equals the first name, takes them as
    its group, until none is left. A bin's samples are few; its pairs are what a task holds.
    """
    import pandas as pd

    names = [r[0] for r in samples.select("sample").distinct().orderBy("sample").limit(100_000).collect()]  # samples are few beside loci
    kind = dict(samples.dtypes)["sample"]

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {n: {n} for n in names}
        for a, b, d in zip(pdf["a"], pdf["b"], pdf["diffs"], strict=True):
            if d <= distance:
                near[a].add(b)
                near[b].add(a)
        left, rows, k = set(names), [], 0
        while left:
            centre = max((n for n in names if n in left), key=lambda n: (len(near[n] & left), -names.index(n)))
            k += 1
            taken = near[centre] & left
            rows += [(*key, n, k) for n in sorted(taken)]
            left -= taken
        return pd.DataFrame(rows, columns=["chrom", "bin", "sample", "grp"])

    kinds = dict(differences.dtypes)
    return differences.groupBy("chrom", "bin").applyInPandas(group, f"chrom {kinds['chrom']}, bin {kinds['bin']}, sample {kind}, grp long")


def allele_words(calls: DataFrame, size: int) -> DataFrame:
    """(chrom, locus, sample, word): the alleles of `size` neighbouring loci of each sample, where all are covered."""
    w = Window.partitionBy("chrom", "sample").orderBy("locus").rowsBetween(0, size - 1)
    d = calls.withColumns({"_n": F.count(F.lit(1)).over(w), "_c": F.count("allele").over(w), "word": F.array_join(F.collect_list(F.col("allele").cast("string")).over(w), "|")})
    return d.filter(F.col("_c") == size).select("chrom", "locus", "sample", "word")


def telling_words(words: DataFrame, groups: DataFrame) -> DataFrame:
    """(chrom, locus, grp, word, n): words that samples of one group only have, with how many do."""
    c = words.join(groups, "sample").groupBy("chrom", "locus", "word", "grp").agg(F.count("*").alias("n"))
    one = c.groupBy("chrom", "locus", "word").agg(F.count("*").alias("k"), F.min("grp").alias("grp"), F.min("n").alias("n")).filter("k = 1")
    return one.select("chrom", "locus", "grp", "word", "n")


def least_word_distance(words: DataFrame, groups: DataFrame) -> DataFrame:
    """(chrom, locus, a, b, least): for every two groups, the fewest places in which a word of one differs from a word of the other. A locus has few distinct words."""
    d = words.join(groups, "sample").select("chrom", "locus", "grp", "word").distinct()
    x, y = (d.select("chrom", "locus", F.col("grp").alias(k), F.split("word", r"\|").alias(f"w{k}")) for k in "ab")
    p = x.join(y, ["chrom", "locus"]).filter("a < b")
    apart = F.aggregate(F.zip_with("wa", "wb", lambda m, n: (m != n).cast("int")), F.lit(0), lambda s, v: s + v)
    return p.groupBy("chrom", "locus", "a", "b").agg(F.min(apart).alias("least"))


def site_gaps(sites: DataFrame) -> DataFrame:
    """(gap, n): how often neighbouring distinct sites of a chromosome are so far apart."""
    from .scans import following

    d = following(sites.select("chrom", "locus").distinct(), ["chrom"], "locus", {"next": "locus"}).filter("next IS NOT NULL")
    return d.groupBy((F.col("next") - F.col("locus")).alias("gap")).agg(F.count("*").alias("n"))


def distinct_sites(sites: DataFrame) -> DataFrame:
    """(chrom, n): distinct loci of each chromosome."""
    return sites.select("chrom", "locus").distinct().groupBy("chrom").agg(F.count("*").alias("n"))


def united(*calls: DataFrame) -> DataFrame:
    """Calls of several tables as one: at a locus of a sample the first table that has an allele counts."""
    parts = [c.select("chrom", "locus", "sample", "allele", F.lit(i).alias("_i")) for i, c in enumerate(calls)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("chrom", "locus", "sample").agg(F.min_by("allele", F.when(F.col("allele").isNotNull(), F.col("_i"))).alias("allele"))


def imputed_counts(counts: DataFrame, called: DataFrame, species: DataFrame, ref: str = "ref") -> DataFrame:
    """counts (chrom, locus, species, base, n) with a row of the reference's base and n 0 for each species that has none at a called locus (chrom, locus, ref)."""
    want = called.select("chrom", "locus", F.col(ref).alias("base")).distinct().join(F.broadcast(species.select("species").distinct().limit(100_000)))  # species are few
    lack = want.join(counts.select("chrom", "locus", "species").distinct(), ["chrom", "locus", "species"], "left_anti")
    return counts.select("chrom", "locus", "species", "base", "n").unionByName(lack.withColumn("n", F.lit(0).cast("bigint")))
