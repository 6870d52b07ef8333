"""Queries of counts, ontologies and haplotypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression as X, haplotypes as H, ontology as O
from ..sources.adapters import annotations, calls, loci, matrix, terms, with_
from ..sources.storage import table

QUERIES, ORACLES = {}, {}


def query(name, oracle):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


_starts = "c AS (SELECT chrom, s, count(*) AS n FROM loci GROUP BY ALL)"


@query(
    "reduce_artefacts",
    with_("loci", then=_starts)
    + """, w AS (SELECT *, sum(n) OVER w - n AS t, count(*) OVER w - 1 AS k FROM c WINDOW w AS (PARTITION BY chrom ORDER BY s RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING)), m AS (SELECT *, 3 * t / k AS m3 FROM w)
    SELECT chrom, s, n, CAST(CASE WHEN n <= 2 THEN n WHEN k = 0 THEN floor(2 + sqrt(n - 2)) WHEN n > floor(m3) THEN floor(m3 + sqrt(n - m3)) ELSE n END AS BIGINT) AS reduced FROM m""",
)
def reduce_artefacts(spark, d):
    c = loci(spark, d).groupBy("chrom", "s").agg(F.count("*").alias("n"))
    return X.reduce_artefacts(c, ["chrom"], "s", "n", 30, 2)


@query(
    "library_scaled",
    with_("loci")
    + """, c AS (SELECT strand, chrom * 100000 + s AS p, count(*) AS n FROM loci GROUP BY ALL), t AS (SELECT strand, sum(n) AS t FROM c GROUP BY strand), f AS (SELECT arg_min(strand, t) AS small, max(t) / min(t) AS f FROM t),
    u AS (SELECT *, sum(n) OVER (PARTITION BY strand ORDER BY p) AS upto FROM c) SELECT strand, p, n, CAST(CASE WHEN strand = small THEN floor(upto * f + 0.5) - floor((upto - n) * f + 0.5) ELSE n END AS BIGINT) AS scaled FROM u, f""",
)
def library_scaled(spark, d):
    c = loci(spark, d).groupBy("strand", (F.col("chrom") * 100_000 + F.col("s")).alias("p")).agg(F.count("*").alias("n"))
    return X.library_scaled(c, "strand", ["p"], "p", "n").select("strand", "p", "n", "scaled")


_bins = "b AS (SELECT chrom, s // 64 AS bin, count(*) FILTER (WHERE strand = '+') AS x, count(*) FILTER (WHERE strand = '-') AS y FROM loci GROUP BY ALL)"


def bins(spark, d):
    n = lambda k: F.count(F.when(F.col("strand") == k, 1))
    return loci(spark, d).groupBy("chrom", F.floor(F.col("s") / 64).alias("bin")).agg(n("+").alias("x"), n("-").alias("y"))


@query(
    "pearson_laplace",
    with_("loci", then=_bins)
    + """, m AS (SELECT chrom, count(*) AS n, avg(x) + 1 AS mx, avg(y) + 1 AS my FROM b WHERE greatest(x, y) >= 1 GROUP BY chrom)
    SELECT chrom, any_value(n) AS n, round(sum((x - mx) * (y - my)) / sqrt(greatest(sum((x - mx) * (x - mx)), 0.00001) * greatest(sum((y - my) * (y - my)), 0.00001)), 6) AS r FROM b JOIN m USING (chrom) WHERE greatest(x, y) >= 1 GROUP BY chrom""",
)
def pearson_laplace(spark, d):
    return X.laplace_pearson(bins(spark, d), ["chrom"], "x", "y").select("chrom", "n", F.round("r", 6).alias("r"))


_cells = "t AS (SELECT chrom, count(*) FILTER (WHERE strand = '+' AND flag = 'N') AS a, count(*) FILTER (WHERE strand = '+' AND flag = 'A') AS b, count(*) FILTER (WHERE strand = '-' AND flag = 'N') AS c, count(*) FILTER (WHERE strand = '-' AND flag = 'A') AS d FROM loci GROUP BY chrom), u AS (SELECT *, CAST(a + b + c + d AS DOUBLE) AS n FROM t), v AS (SELECT *, (a + b) * (a + c) / n AS ea, (a + b) * (b + d) / n AS eb, (c + d) * (a + c) / n AS ec, (c + d) * (b + d) / n AS ed FROM u)"


def cells(spark, d):
    n = lambda s, f: F.count(F.when((F.col("strand") == s) & (F.col("flag") == f), 1))
    return loci(spark, d).groupBy("chrom").agg(n("+", "N").alias("a"), n("+", "A").alias("b"), n("-", "N").alias("c"), n("-", "A").alias("d"))


@query("chi_square_checked", with_("loci", then=_cells) + " SELECT chrom, round(CASE WHEN n > 0 AND least(ea, eb, ec, ed) >= 5 THEN (a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb + (c - ec) * (c - ec) / ec + (d - ed) * (d - ed) / ed ELSE -1 END, 6) AS chi2 FROM v")
def chi_square_checked(spark, d):
    return cells(spark, d).select("chrom", F.round(X.chi_square(*map(F.col, "abcd")), 6).alias("chi2"))


@query(
    "coalesced_starts",
    "WITH RECURSIVE " + with_("loci", then=_starts).removeprefix("WITH ")
    + """, n AS (SELECT chrom, s, min(s) OVER (PARTITION BY chrom ORDER BY s RANGE BETWEEN 20 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM c),
    a AS (SELECT chrom, min(s) AS start FROM c GROUP BY chrom UNION ALL SELECT n.chrom, n.nx FROM a JOIN n ON n.chrom = a.chrom AND n.s = a.start WHERE n.nx IS NOT NULL)
    SELECT a.chrom, a.start, CAST(sum(c.n) AS BIGINT) AS n FROM a JOIN c ON c.chrom = a.chrom AND c.s >= a.start AND c.s < a.start + 20 GROUP BY ALL""",
)
def coalesced_starts(spark, d):
    c = loci(spark, d).groupBy("chrom", "s").agg(F.count("*").alias("n"))
    return X.coalesced_starts(c, "chrom", "s", "n", 20)


_calls = with_("matrix", "calls")
_some = "k AS (SELECT * FROM calls WHERE allele IS NOT NULL)"


@query(
    "modal_allele",
    _calls + f", {_some}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom, locus, allele ORDER BY sample) AS i FROM k), t AS (SELECT chrom, locus, allele, count(*) AS n, max(sample) AS o FROM k GROUP BY ALL) SELECT chrom, locus, allele, n FROM t QUALIFY row_number() OVER (PARTITION BY chrom, locus ORDER BY n DESC, o) = 1",
)
def modal_allele(spark, d):
    return H.modal_allele(calls(spark, d), ["chrom", "locus"])


@query(
    "group_consensus",
    _calls + f", {_some}, t AS (SELECT chrom, locus, grp, allele, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT chrom, locus, grp, sum(n) AS covered, max(n) AS m, arg_max(allele, n * 10 + allele) AS a FROM t GROUP BY ALL) SELECT chrom, locus, grp, CAST(CASE WHEN covered < 15 THEN {H.SMALL} WHEN m < 0.3 * covered THEN {H.MIXED} ELSE a END AS INTEGER) AS allele FROM g",
)
def group_consensus(spark, d):
    c = calls(spark, d)
    return H.group_consensus(c.drop("grp"), c.select("sample", "grp").distinct(), 15, 0.3)


@query(
    "group_markers",
    _calls + f""", {_some}, z AS (SELECT grp, count(DISTINCT sample) AS size FROM calls GROUP BY grp), t AS (SELECT chrom, locus, grp, allele, count(*) AS tp FROM k GROUP BY ALL), w AS (SELECT chrom, locus, allele, sum(tp) AS w FROM t GROUP BY ALL)
    SELECT chrom, locus, grp, allele, tp, CAST(w - tp AS BIGINT) AS fp, size - tp AS fn, round(tp / w, 6) AS precision, round(tp / size, 6) AS recall, round(2 * (tp / w) * (tp / size) / (tp / w + tp / size), 6) AS f FROM t JOIN w USING (chrom, locus, allele) JOIN z USING (grp)""",
)
def group_markers(spark, d):
    c = calls(spark, d)
    m = H.group_markers(c.drop("grp"), c.select("sample", "grp").distinct())
    return m.select("chrom", "locus", "grp", "allele", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f")])


_rough = "q AS (SELECT chrom, locus, grp AS sample, arg_max(allele, n * 10 + allele) AS allele FROM (SELECT chrom, locus, grp, allele, count(*) AS n FROM calls WHERE allele IS NOT NULL AND sample % 3 = locus % 3 GROUP BY ALL) GROUP BY ALL)"


def rough(spark, d):
    """One call for each label and locus: the most frequent allele of a third of its samples."""
    c = calls(spark, d).filter("allele is not null and sample % 3 = locus % 3").groupBy("chrom", "locus", F.col("grp").alias("sample"), "allele").agg(F.count("*").alias("n"))
    return c.groupBy("chrom", "locus", "sample").agg(F.max(F.struct("n", "allele"))["allele"].alias("allele"))


@query("pair_scores", _calls + f", {_rough} SELECT x.chrom, x.locus // 10 AS bin, x.sample AS a, y.sample AS b, count(*) AS both, count(*) FILTER (WHERE x.allele = y.allele) AS same FROM q x JOIN q y ON x.chrom = y.chrom AND x.locus = y.locus AND x.sample < y.sample GROUP BY ALL")
def pair_scores(spark, d):
    return H.pair_scores(rough(spark, d), 10)


@query("homozygosity", _calls + f", {_rough} SELECT x.chrom, x.locus // 16 AS bin, x.sample AS a, y.sample AS b, round(count(*) FILTER (WHERE x.allele = y.allele) / count(*), 6) AS score FROM q x JOIN q y ON x.chrom = y.chrom AND x.locus = y.locus AND x.sample < y.sample GROUP BY ALL")
def homozygosity(spark, d):
    return H.homozygosity(rough(spark, d), 16).withColumn("score", F.round("score", 6))


@query(
    "allele_concordance",
    _calls + f", {_rough}, n AS (SELECT count(DISTINCT sample) AS n FROM q), l AS (SELECT chrom, locus, count(*) AS c, max(k) AS m FROM (SELECT chrom, locus, count(*) OVER (PARTITION BY chrom, locus, allele) AS k FROM q) GROUP BY ALL) SELECT chrom, count(*) AS loci, count(*) FILTER (WHERE c = n) AS full, count(*) FILTER (WHERE 2 * c >= n) AS half, count(*) FILTER (WHERE c = n AND m = n) AS same, count(*) FILTER (WHERE c = n AND 2 * m >= n) AS alike FROM l, n GROUP BY chrom",
)
def allele_concordance(spark, d):
    q = rough(spark, d)
    return H.concordance(q, q.select("sample").distinct().count())


@query(
    "window_majority",
    _calls + f""", p AS (SELECT a.chrom, a.sample, a.locus, b.allele AS near, count(*) AS n FROM calls a JOIN calls b ON a.chrom = b.chrom AND a.sample = b.sample AND abs(a.locus - b.locus) <= 3 WHERE b.allele IS NOT NULL GROUP BY ALL),
    t AS (SELECT chrom, sample, locus, sum(n) AS al, max(n) AS m, arg_min(near, -10 * n + near) AS f FROM p GROUP BY ALL) SELECT c.chrom, c.sample, c.locus, CAST(CASE WHEN t.m >= 0.4 * t.al THEN t.f ELSE c.allele END AS BIGINT) AS filled FROM calls c LEFT JOIN t USING (chrom, sample, locus)""",
)
def window_majority(spark, d):
    return H.window_majority(calls(spark, d), 3, 0.4).select("chrom", "sample", "locus", F.col("filled").cast("bigint").alias("filled"))


@query("shared_sites", with_("loci") + ", s AS (SELECT DISTINCT flag || strand AS readset, chrom, s AS locus FROM loci), n AS (SELECT readset, count(*) AS n FROM s GROUP BY readset), p AS (SELECT x.readset AS a, y.readset AS b, count(*) AS shared FROM s x JOIN s y ON x.chrom = y.chrom AND x.locus = y.locus AND x.readset < y.readset GROUP BY ALL) SELECT a, b, shared, round(shared / (u.n + v.n - shared), 6) AS jaccard FROM p JOIN n u ON u.readset = a JOIN n v ON v.readset = b")
def shared_sites(spark, d):
    s = loci(spark, d).select(F.concat("flag", "strand").alias("readset"), "chrom", F.col("s").alias("locus"))
    return H.shared_sites(s).withColumn("jaccard", F.round("jaccard", 6))


_seg = "b AS (SELECT chrom, flag AS founder, s // 50 AS bin, count(*) AS n FROM loci GROUP BY ALL)"


@query("binned_segments", with_("loci", then=_seg) + " SELECT chrom, founder, bin, n FROM b")
def binned_segments(spark, d):
    return H.binned_segments(loci(spark, d).withColumnRenamed("flag", "founder"), 50)


@query(
    "called_segments",
    with_("loci", then=_seg) + ", t AS (SELECT chrom, bin, sum(n) AS al, max(n) AS m, max_by(founder, (n, founder)) AS founder FROM b GROUP BY ALL), c AS (SELECT *, bin - row_number() OVER (PARTITION BY chrom, founder ORDER BY bin) AS run FROM t WHERE m >= 3 AND m >= 0.5 * al) SELECT chrom, founder, min(bin) AS s, max(bin) AS e FROM c GROUP BY chrom, founder, run",
)
def called_segments(spark, d):
    return H.called_segments(H.binned_segments(loci(spark, d).withColumnRenamed("flag", "founder"), 50), 3, 0.5)


@query(
    "specific_alleles",
    with_("loci") + ", c AS (SELECT chrom, s // 20 AS locus, flag AS species, CAST(qty % 4 AS BIGINT) AS base, count(*) AS n FROM loci GROUP BY ALL), t AS (SELECT chrom, locus, species, sum(n) AS al, max(n) AS m, max_by(base, (n, base)) AS base FROM c GROUP BY ALL) SELECT chrom, locus, species, base FROM t WHERE m >= 2 AND (m + 1) / al >= 0.6 AND NOT EXISTS (SELECT 1 FROM c WHERE c.chrom = t.chrom AND c.locus = t.locus AND c.base = t.base AND c.species <> t.species AND c.n >= 2)",
)
def specific_alleles(spark, d):
    c = loci(spark, d).groupBy("chrom", F.floor(F.col("s") / 20).alias("locus"), F.col("flag").alias("species"), (F.col("qty") % 4).alias("base")).agg(F.count("*").alias("n"))
    return H.specific_alleles(c, 2, 0.6, 2)


@query("best_founders", with_("loci") + " SELECT part AS progeny, chrom AS founder, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, chrom) AS rank FROM (SELECT part, chrom, CAST(sum(qty) AS BIGINT) AS score FROM loci GROUP BY ALL)) WHERE rank <= 2")
def best_founders(spark, d):
    s = loci(spark, d).groupBy(F.col("part").alias("progeny"), F.col("chrom").alias("founder")).agg(F.sum("qty").alias("score"))
    return H.best_founders(s, 2).withColumn("rank", F.col("rank").cast("bigint"))


_up = "WITH RECURSIVE " + with_("terms", "annotations").removeprefix("WITH ") + ", up AS (SELECT child AS term, parent AS ancestor FROM terms UNION SELECT up.term, t.parent FROM up JOIN terms t ON t.child = up.ancestor)"


@query("term_ancestors", _up + " SELECT term, ancestor FROM up")
def term_ancestors(spark, d):
    return O.ancestors(terms(spark, d))


@query("term_roots", _up + " SELECT term, ancestor AS root FROM up WHERE ancestor NOT IN (SELECT child FROM terms) UNION ALL SELECT DISTINCT parent, parent FROM terms WHERE parent NOT IN (SELECT child FROM terms)")
def term_roots(spark, d):
    return O.root_of(terms(spark, d))


@query("term_children", with_("terms") + " SELECT DISTINCT parent, child FROM terms")
def term_children(spark, d):
    return O.back_references(terms(spark, d))


_per = _up + ", per AS (SELECT gene, term FROM annotations UNION SELECT gene, ancestor FROM annotations JOIN up USING (term))"


@query("term_genes", _per + " SELECT term, count(*) AS genes FROM per GROUP BY term")
def term_genes(spark, d):
    return O.gene_counts(annotations(spark, d), terms(spark, d))


@query(
    "term_enrichment",
    _per + """, s AS (SELECT * FROM per WHERE gene % 10 = 3), c AS (SELECT term, count(*) AS k FROM s GROUP BY term), n AS (SELECT term, count(*) AS n1 FROM per GROUP BY term),
    q AS (SELECT term, k, (SELECT count(DISTINCT gene) FROM s) AS t, n1, (SELECT count(DISTINCT gene) FROM per) - n1 AS n2 FROM c JOIN n USING (term)),
    e AS (SELECT *, CAST(t + n1 + n2 AS DOUBLE) AS z, t * (t - k + n2) / z AS ea, t * (k + n1) / z AS eb, (n1 + n2) * (t - k + n2) / z AS ec, (n1 + n2) * (k + n1) / z AS ed FROM q)
    SELECT term, k, t, n1, n2, round(CASE WHEN least(ea, eb, ec, ed) >= 5 THEN (t - k - ea) * (t - k - ea) / ea + (k - eb) * (k - eb) / eb + (n2 - ec) * (n2 - ec) / ec + (n1 - ed) * (n1 - ed) / ed ELSE -1 END, 6) AS chi2 FROM e""",
)
def term_enrichment(spark, d):
    a = annotations(spark, d)
    e = O.enriched(a, terms(spark, d), a.filter("gene % 10 = 3").select("gene"))
    return e.select("term", "k", "t", "n1", "n2", F.round("chi2", 6).alias("chi2"))


@query("weight_reduced", "SELECT lower(trim(p_brand)) AS gene, max(p_retailprice) AS weight FROM part GROUP BY 1")
def weight_reduced(spark, d):
    return O.weight_reduced(table(spark, d, "part").select(F.col("p_brand").alias("gene"), F.col("p_retailprice").alias("weight")))


@query("column_profile", with_("matrix") + " SELECT label, col, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS deviation FROM matrix GROUP BY ALL")
def column_profile(spark, d):
    return matrix(spark, d).groupBy("label", "col").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 4).alias("deviation"))
