"""Queries of the series operators and of alleles, CIGARs and other functions on columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alleles, cigar, sequence, statistics
from ..operators import scans, series as S, tables as T
from ..sources.adapters import features, loci, series, with_
from ..sources.storage import table

QUERIES, ORACLES = {}, {}


def query(name, oracle):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


_window = "x AS (SELECT *, count(*) OVER (PARTITION BY chrom) AS n FROM series), y AS (SELECT *, least(n, {w}) AS w FROM x), z AS (SELECT *, CAST(trunc(sum(cents) OVER (PARTITION BY chrom ORDER BY pos, event_id ROWS BETWEEN w - w // 2 PRECEDING AND w // 2 - 1 FOLLOWING) / count(*) OVER (PARTITION BY chrom ORDER BY pos, event_id ROWS BETWEEN w - w // 2 PRECEDING AND w // 2 - 1 FOLLOWING)) AS BIGINT) AS mean FROM y)"


@query("window_mean", with_("series", then=_window.format(w=25)) + " SELECT event_id, CASE WHEN n < 10 THEN cents ELSE mean END AS smooth FROM z")
def window_mean(spark, d):
    return S.window_mean(series(spark, d), ["chrom"], ["pos", "event_id"], "cents", 25, "smooth").select("event_id", "smooth")


@query("above_baseline", with_("series", then=_window.format(w=100)) + " SELECT event_id, CASE WHEN n < 10 THEN cents ELSE greatest(cents - mean, 0) END AS above FROM z")
def above_baseline(spark, d):
    return S.above_baseline(series(spark, d), ["chrom"], ["pos", "event_id"], "cents", 100, "above").select("event_id", "above")


@query(
    "smooth_steps",
    with_("series") + ", x AS (SELECT *, row_number() OVER w AS k, cents - lag(cents) OVER w AS step, count(*) OVER (PARTITION BY chrom) AS n FROM series WINDOW w AS (PARTITION BY chrom ORDER BY pos, event_id)), y AS (SELECT *, coalesce(CAST(trunc(step / least(k, 8)) AS BIGINT), cents) AS part FROM x) SELECT event_id, CAST(CASE WHEN n < 8 THEN cents ELSE sum(part) OVER (PARTITION BY chrom ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS smooth FROM y",
)
def smooth_steps(spark, d):
    return S.smooth_steps(series(spark, d), ["chrom"], ["pos", "event_id"], "cents", 8, "smooth").select("event_id", "smooth")


_hours = "b AS (SELECT event_type, CAST(pos // 3600 AS BIGINT) AS bin, count(*) AS n FROM series GROUP BY 1, 2)"


def hours(spark, d):
    return series(spark, d).groupBy("event_type", F.floor(F.col("pos") / 3600).alias("bin")).agg(F.count("*").alias("n"))


@query("half_neighbours", with_("series", then=_hours) + " SELECT b.event_type, b.bin, CAST(b.n + coalesce(p.n // 2, 0) + coalesce(q.n // 2, 0) AS BIGINT) AS smooth FROM b LEFT JOIN b p ON p.event_type = b.event_type AND p.bin = b.bin - 1 LEFT JOIN b q ON q.event_type = b.event_type AND q.bin = b.bin + 1")
def half_neighbours(spark, d):
    return S.half_neighbours(hours(spark, d), ["event_type"], "bin", "n", "smooth").select("event_type", "bin", "smooth")


@query(
    "filled_calls",
    with_("series", then=_hours) + ", c AS (SELECT *, CASE WHEN n >= 3 THEN n % 4 END AS called FROM b), l AS (SELECT *, lag(called) OVER w AS lft, lead(called) OVER w AS rgt FROM c WINDOW w AS (PARTITION BY event_type ORDER BY bin)) SELECT event_type, bin, CAST(CASE WHEN bin % 2 <> 0 THEN coalesce(called, lft, rgt) ELSE coalesce(called, rgt, lft) END AS BIGINT) AS filled FROM l",
)
def filled_calls(spark, d):
    called = hours(spark, d).withColumn("called", F.when(F.col("n") >= 3, F.col("n") % 4))
    return S.filled_calls(called, ["event_type"], "bin", "called", "filled").select("event_type", "bin", "filled")


@query(
    "trim_runs",
    with_("loci") + ", p AS (SELECT DISTINCT chrom, s FROM loci), r AS (SELECT *, s - row_number() OVER (PARTITION BY chrom ORDER BY s) AS run FROM p), m AS (SELECT *, min(s) OVER (PARTITION BY chrom, run) AS a, max(s) OVER (PARTITION BY chrom, run) AS z FROM r) SELECT chrom, s FROM m WHERE s >= a + 1 AND s <= z - 1",
)
def trim_runs(spark, d):
    return S.trim_runs(loci(spark, d).select("chrom", "s").distinct(), ["chrom"], "s", 1, 1).select("chrom", "s")


@query("top_hits", "SELECT l_partkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def top_hits(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return T.top_per_group(rows, ["l_partkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3).select("l_partkey", "l_orderkey", "l_linenumber", F.col("rank").cast("bigint").alias("rank"))


@query("distinct_starts", with_("loci") + " SELECT chrom, CAST(s // 64 AS BIGINT) AS bin, strand, count(*) AS n, count(DISTINCT s) AS starts FROM loci GROUP BY ALL")
def distinct_starts(spark, d):
    # Equal starts become one row before the second count: no set of starts is held.
    at = loci(spark, d).groupBy("chrom", "strand", "s").agg(F.count("*").alias("k"))
    return at.groupBy("chrom", F.floor(F.col("s") / 64).alias("bin"), "strand").agg(F.sum("k").alias("n"), F.count("*").alias("starts"))


@query(
    "start_profile",
    with_("loci", "features") + ", l AS (SELECT chrom, s, count(*) AS k FROM loci GROUP BY ALL), f AS (SELECT chrom, s, cls, count(*) AS k FROM features GROUP BY ALL) SELECT cls, rel, CAST(sum(f.k * l.k) AS BIGINT) AS n FROM f, range(-5, 6) r(rel) JOIN l ON l.chrom = f.chrom AND l.s = f.s + r.rel GROUP BY ALL",
)
def start_profile(spark, d):
    """Loci that start at each offset from a feature's start, by class of feature."""
    at = loci(spark, d).groupBy("chrom", "s").agg(F.count("*").alias("k"))
    of = features(spark, d).groupBy("chrom", "s", "cls").agg(F.count("*").alias("m"))
    of = of.select("chrom", "cls", "m", F.col("s").alias("f"), F.explode(F.sequence(F.lit(-5).cast("bigint"), F.lit(5).cast("bigint"))).alias("rel")).withColumn("s", F.col("f") + F.col("rel"))
    # The size that is guessed for `of` is that of the files, before rows are dealt out: never gathered in the driver.
    return of.hint("merge").join(at, ["chrom", "s"]).groupBy("cls", "rel").agg(F.sum(F.col("m") * F.col("k")).alias("n"))


@query(
    "pseudo_genome",
    "SELECT doc_id, CAST(coalesce(sum(n_chars + 100) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, n_chars AS len FROM documents",
)
def pseudo_genome(spark, d):
    """Where each text begins when all stand in a row, 100 places apart."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("len")).withColumn("all", F.lit(1))
    ends = scans.running_sum(docs, ["all"], ["doc_id"], "doc_id", F.col("len") + 100, "upto", width=4096)
    return ends.select("doc_id", (F.col("upto") - F.col("len") - 100).alias("s"), "len")


_bases = "q AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS q FROM documents)"


@query(
    "trimer_score",
    f"WITH {_bases}, k AS (SELECT doc_id, substr(q, i, 3) AS kmer, count(*) AS n FROM (SELECT doc_id, q, unnest(range(1, length(q) - 1)) AS i FROM q) GROUP BY ALL), r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS k FROM k), t AS (SELECT doc_id, sum(n) AS top FROM r WHERE k <= 3 GROUP BY doc_id) SELECT q.doc_id, CAST(CASE WHEN length(q) < 6 THEN 0 ELSE top * 100 // (length(q) - 2) END AS BIGINT) AS score FROM q LEFT JOIN t USING (doc_id) WHERE q.q IS NOT NULL",
)
def trimer_score(spark, d):
    """Share of the three most frequent trimers, in percent: high where a sequence repeats itself."""
    bases = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("text")).filter("text IS NOT NULL")
    counts = T.kmer_counts(bases, 3, ["doc_id"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(-F.col("n"))).alias("n"))  # 64 at most
    top = counts.select("doc_id", F.aggregate(F.slice("n", 1, 3), F.lit(0).cast("bigint"), lambda a, x: a - x).alias("top"))
    size = F.char_length("text")
    score = F.when(size < 6, F.lit(0).cast("bigint")).otherwise(F.floor(F.col("top") * 100 / (size - 2)))
    return bases.join(top, "doc_id", "left").select("doc_id", score.alias("score"))


_pba = "p AS (SELECT l_orderkey, l_linenumber, CAST((l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 256 AS INTEGER) AS p FROM lineitem), v AS (SELECT *, (p >> 6) & 3 AS a, (p >> 4) & 3 AS c, (p >> 2) & 3 AS g, p & 3 AS t FROM p)"
_best = "CASE WHEN greatest({0}a, {0}c, {0}g, {0}t) = 0 THEN 0 WHEN {0}a = greatest({0}a, {0}c, {0}g, {0}t) THEN 192 WHEN {0}c = greatest({0}a, {0}c, {0}g, {0}t) THEN 48 WHEN {0}g = greatest({0}a, {0}c, {0}g, {0}t) THEN 12 ELSE 3 END"


@query(
    "allele_calls",
    f"WITH {_pba}, h AS (SELECT *, {_best.format('')} AS one FROM v), r AS (SELECT *, CASE one WHEN 192 THEN 0 ELSE a END AS ra, CASE one WHEN 48 THEN 0 ELSE c END AS rc, CASE one WHEN 12 THEN 0 ELSE g END AS rg, CASE one WHEN 3 THEN 0 ELSE t END AS rt FROM h) SELECT l_orderkey, l_linenumber, CAST(one AS INTEGER) AS haploid, CAST(CASE WHEN (p & one) = one THEN one ELSE one | ({_best.format('r')}) END AS INTEGER) AS diploid, (a > 0)::INT + (c > 0)::INT + (g > 0)::INT + (t > 0)::INT <= 1 AS single FROM r",
)
def allele_calls(spark, d):
    p = ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % 256).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", alleles.haploid(p).alias("haploid"), alleles.diploid(p).alias("diploid"), alleles.single(p).alias("single"))


_cigar = "(l_partkey % 90 + 1) || 'M' || (l_linenumber) || 'I' || (l_suppkey % 9 + 1) || 'D' || (l_orderkey % 50 + 1) || '=' || (l_linenumber + 2) || 'S'"


@query(
    "cigar_lengths",
    "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 90 + 1 + l_orderkey % 50 + 1 AS BIGINT) AS aligned, CAST(l_partkey % 90 + 1 + l_suppkey % 9 + 1 + l_orderkey % 50 + 1 AS BIGINT) AS on_reference, CAST(l_partkey % 90 + 1 + l_linenumber + l_orderkey % 50 + 1 + l_linenumber + 2 AS BIGINT) AS on_read FROM lineitem",
)
def cigar_lengths(spark, d):
    rows = table(spark, d, "lineitem").withColumn("cigar", F.expr(_cigar))
    c = F.col("cigar")
    return rows.select("l_orderkey", "l_linenumber", cigar.aligned(c).alias("aligned"), cigar.on_reference(c).alias("on_reference"), cigar.on_read(c).alias("on_read"))


@query(
    "correlation_interval",
    with_("series") + ", c AS (SELECT event_type, count(*) AS n, corr(pos % 86400, cents) AS r FROM series GROUP BY 1) SELECT event_type, n, round((exp(2 * (atanh(r) - q)) - 1) / (exp(2 * (atanh(r) - q)) + 1), 6) AS lower, round((exp(2 * (atanh(r) + q)) - 1) / (exp(2 * (atanh(r) + q)) + 1), 6) AS upper FROM (SELECT *, 1.959963984540::DOUBLE / sqrt(greatest(n, 4) - 3) AS q FROM c)",
)
def correlation_interval(spark, d):
    c = series(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.corr(F.col("pos") % 86400, F.col("cents")).alias("r"))
    lower, upper = statistics.correlation_interval(F.col("r"), F.col("n"), 95)
    return c.select("event_type", "n", F.round(lower, 6).alias("lower"), F.round(upper, 6).alias("upper"))


@query("canonical_dedupe", "SELECT least(p_name, translate(reverse(p_name), 'ACGTUacgtu', 'TGCAAtgcaa')) AS seq, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1")
def canonical_dedupe(spark, d):
    """One row for sequences that are equal on either strand."""
    return table(spark, d, "part").groupBy(sequence.canonical(F.col("p_name")).alias("seq")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))


@query("sub_sequences", "SELECT p_partkey, CAST(i AS INTEGER) AS at, substr(p_name, i + 1, 8) AS seq FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name), 4)) AS i FROM part)")
def sub_sequences(spark, d):
    return table(spark, d, "part").select("p_partkey", F.inline(sequence.sub_sequences(F.col("p_name"), 8, 4)))
