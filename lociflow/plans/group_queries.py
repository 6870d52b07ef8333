"""Queries of groups of samples, words of alleles, tables by region, depth of features and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import haplotypes as H, intervals as I, tables as T
from ..sources import relational as R
from ..sources.adapters import calls, features, genes, loci, matrix, with_
from ..sources.storage import table
from .expression_queries import _calls, _rough, rough

QUERIES, ORACLES = {}, {}


def query(name, oracle):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


_some = "k AS (SELECT * FROM calls WHERE allele IS NOT NULL)"


@query("difference_counts", _calls + f", {_rough} SELECT x.chrom, x.locus // 8 AS bin, x.sample AS a, y.sample AS b, count(*) FILTER (WHERE x.allele <> y.allele) AS diffs, count(*) AS both FROM q x JOIN q y ON x.chrom = y.chrom AND x.locus = y.locus AND x.sample < y.sample GROUP BY ALL")
def difference_counts(spark, d):
    return H.difference_counts(rough(spark, d), 8)


_words = "w AS (SELECT chrom, locus, sample, grp, string_agg(CAST(allele AS VARCHAR), '|') OVER v AS word, count(allele) OVER v AS c FROM calls WINDOW v AS (PARTITION BY chrom, sample ORDER BY locus ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), x AS (SELECT * FROM w WHERE c = 3)"


def words(spark, d):
    c = calls(spark, d)
    return H.allele_words(c.drop("grp"), 3), c.select("sample", "grp").distinct()


@query("allele_words", _calls + f", {_words} SELECT chrom, locus, sample, word FROM x")
def allele_words(spark, d):
    return words(spark, d)[0]


@query("telling_words", _calls + f", {_words} SELECT chrom, locus, min(grp) AS grp, word, count(*) AS n FROM x GROUP BY chrom, locus, word HAVING count(DISTINCT grp) = 1")
def telling_words(spark, d):
    return H.telling_words(*words(spark, d))


@query("least_word_distance", _calls + f", {_words}, u AS (SELECT DISTINCT chrom, locus, grp, string_split(word, '|') AS w FROM x) SELECT a.chrom, a.locus, a.grp AS a, b.grp AS b, CAST(min((a.w[1] <> b.w[1])::INT + (a.w[2] <> b.w[2])::INT + (a.w[3] <> b.w[3])::INT) AS INTEGER) AS least FROM u a JOIN u b ON a.chrom = b.chrom AND a.locus = b.locus AND a.grp < b.grp GROUP BY ALL")
def least_word_distance(spark, d):
    return H.least_word_distance(*words(spark, d))


@query("site_gaps", with_("loci") + ", s AS (SELECT DISTINCT chrom, s FROM loci), g AS (SELECT lead(s) OVER (PARTITION BY chrom ORDER BY s) - s AS gap FROM s) SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap")
def site_gaps(spark, d):
    return H.site_gaps(loci(spark, d).select("chrom", F.col("s").alias("locus")))


@query("distinct_sites", with_("loci") + " SELECT chrom, count(DISTINCT s) AS n FROM loci GROUP BY chrom")
def distinct_sites(spark, d):
    return H.distinct_sites(loci(spark, d).select("chrom", F.col("s").alias("locus")))


@query("united_calls", _calls + " SELECT chrom, locus, sample, coalesce(CASE WHEN (sample + locus) % 3 <> 0 THEN allele END, (locus + 1) % 5) AS allele FROM calls")
def united_calls(spark, d):
    c = calls(spark, d)
    one = c.withColumn("allele", F.when((F.col("sample") + F.col("locus")) % 3 != 0, F.col("allele")))
    return H.united(one, c.withColumn("allele", (F.col("locus") + 1) % 5)).select("chrom", "locus", "sample", "allele")


@query("imputed_counts", with_("loci") + ", c AS (SELECT chrom, s // 20 AS locus, flag AS species, qty % 4 AS base, count(*) AS n FROM loci GROUP BY ALL), r AS (SELECT DISTINCT chrom, locus, locus % 4 AS base FROM c), v AS (SELECT DISTINCT species FROM c) SELECT * FROM c UNION ALL SELECT r.chrom, r.locus, v.species, r.base, 0 FROM r, v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.chrom = r.chrom AND c.locus = r.locus AND c.species = v.species)")
def imputed_counts(spark, d):
    c = loci(spark, d).groupBy("chrom", F.floor(F.col("s") / 20).alias("locus"), F.col("flag").alias("species"), (F.col("qty") % 4).alias("base")).agg(F.count("*").alias("n"))
    called = c.select("chrom", "locus", (F.col("locus") % 4).alias("ref")).distinct()
    return H.imputed_counts(c, called, c.select("species"))


@query("top_columns", with_("matrix") + " SELECT col, count(*) AS support FROM matrix WHERE v >= 100000 GROUP BY col ORDER BY support DESC, col LIMIT 12")
def top_columns(spark, d):
    """The 12 columns of most support: the limit is the feature."""
    return T.top_columns(matrix(spark, d).withColumnRenamed("v", "value"), 100_000, 12)


_min = "(SELECT count(*) // 50 FROM embeddings)"


@query("column_sets", with_("matrix") + f", h AS (SELECT DISTINCT row, col FROM matrix WHERE v >= 100000) SELECT a.col AS x, b.col AS y, c.col AS z, count(*) AS support FROM h a JOIN h b ON a.row = b.row AND a.col < b.col JOIN h c ON b.row = c.row AND b.col < c.col GROUP BY ALL HAVING count(*) >= greatest({_min}, 3)")
def column_sets(spark, d):
    """Sets of three columns that reach a value together in a fiftieth of the rows, or in three."""
    n = max(table(spark, d, "embeddings").count() // 50, 3)
    s = T.column_sets(matrix(spark, d).withColumnRenamed("v", "value"), 100_000, 3, n)
    return s.select(*[F.get("items", F.lit(i)).alias(k) for i, k in enumerate("xyz")], "support")


@query("region_table", with_("loci") + ", x AS (SELECT chrom, flag, e - s + 1 AS len FROM loci) SELECT chrom, " + ", ".join(f"CAST(sum(CASE WHEN flag = '{f}' THEN len ELSE 0 END) AS BIGINT) AS r_{f}" for f in "ANR") + ", " + ", ".join(f"round(100.0 * sum(CASE WHEN flag = '{f}' THEN len ELSE 0 END) / sum(len), 6) AS p_{f}" for f in "ANR") + " FROM x GROUP BY chrom")
def region_table(spark, d):
    t = T.region_table(loci(spark, d), "chrom", "flag", list("ANR"), F.col("e") - F.col("s") + 1)
    return t.select("chrom", *[f"r_{f}" for f in "ANR"], *[F.round(f"p_{f}", 6).alias(f"p_{f}") for f in "ANR"])


@query("feature_depth", with_("loci", "features") + " SELECT r.name, r.s AS start, r.chrom, CAST(sum(least(l.e, r.e) - greatest(l.s, r.s) + 1) AS BIGINT) AS total FROM loci l JOIN features r ON l.chrom = r.chrom AND l.s <= r.e AND l.e >= r.s GROUP BY ALL")
def feature_depth(spark, d):
    f = features(spark, d)
    seg = I.depth_segments(loci(spark, d), ["chrom"], {"n": F.lit(True)})
    t = T.feature_depth(seg, f, "n").select("name", "total")
    return t.join(f.select("name", "chrom", F.col("s").alias("start")), "name").select("name", "start", "chrom", "total")


@query("feature_bins", with_("loci", "features", "genes") + " SELECT name, CAST((CASE WHEN g.strand = '-' THEN g.e - l.s ELSE l.s - g.s END) * 6 // (g.e - g.s + 1) AS BIGINT) AS bin, count(*) FILTER (WHERE l.strand = '+') AS control, count(*) FILTER (WHERE l.strand = '-') AS treated FROM loci l JOIN genes g ON l.chrom = g.chrom AND l.s BETWEEN g.s AND g.e GROUP BY 1, 2")
def feature_bins(spark, d):
    return T.feature_bins(loci(spark, d), genes(spark, d), 6, {"control": F.col("strand") == "+", "treated": F.col("strand") == "-"})


_bins = "b AS (SELECT chrom, s // 16 AS bin, count(*) FILTER (WHERE strand = '+') AS x, count(*) FILTER (WHERE strand = '-') AS y FROM loci GROUP BY ALL)"


@query("bin_overlap", with_("loci", then=_bins) + " SELECT chrom, count(*) FILTER (WHERE x > 0 AND y > 0) AS both, count(*) FILTER (WHERE x > 0 AND y = 0) AS only_x, count(*) FILTER (WHERE x = 0 AND y > 0) AS only_y FROM b GROUP BY chrom")
def bin_overlap(spark, d):
    n = lambda k: F.count(F.when(F.col("strand") == k, 1))
    b = loci(spark, d).groupBy("chrom", F.floor(F.col("s") / 16).alias("bin")).agg(n("+").alias("x"), n("-").alias("y"))
    return T.bin_overlap(b, ["chrom"], "x", "y")


@query("profile_agreement", "WITH km AS (SELECT lang, substr(lower(text), CAST(i AS BIGINT), 2) AS kmer, count(*) AS n FROM documents, LATERAL (SELECT unnest(range(1, length(text))) AS i) t GROUP BY ALL), l AS (SELECT DISTINCT lang FROM documents), m AS (SELECT DISTINCT kmer FROM km), f AS (SELECT l.lang, m.kmer, coalesce(n, 0) AS n FROM l CROSS JOIN m LEFT JOIN km ON km.lang = l.lang AND km.kmer = m.kmer) SELECT x.lang AS a, y.lang AS b, round(corr(x.n, y.n), 6) AS r FROM f x JOIN f y ON x.kmer = y.kmer AND x.lang < y.lang GROUP BY ALL")
def profile_agreement(spark, d):
    t = table(spark, d, "documents").select("lang", F.lower("text").alias("text"))
    c = T.kmer_counts(t, 2, ["lang"])
    return T.profile_agreement(c, "lang", "kmer", "n").select("a", "b", F.round("r", 6).alias("r"))


def snp_sites(spark, d):
    l = loci(spark, d)
    base = F.substring(F.lit("ACGT"), (F.col("s") % 4 + 1).cast("int"), F.lit(1))
    q = F.col("qty")
    return l.select(
        F.col("flag").alias("species"), F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "s", base.alias("ref"), (q % 5).alias("a"), (q % 7).alias("c"), (q % 3).alias("g"), (q % 2).alias("t"), F.lit(0).cast("bigint").alias("n"),
        q.alias("bases"), (q % 6).alias("mismatches"), F.when(q >= 45, F.lit("T")).alias("marker"), q.cast("int").alias("score"),
    )


_snp = with_("loci") + ", z AS (SELECT flag AS species, 'chr' || chrom AS chrom, s, substr('ACGT', CAST(s % 4 + 1 AS INTEGER), 1) AS ref, qty FROM loci), cult AS (SELECT CultName, row_number() OVER (ORDER BY CultName) AS CultID FROM (SELECT DISTINCT species AS CultName FROM z UNION SELECT 'target')), seq AS (SELECT chrom AS SeqName, row_number() OVER (ORDER BY chrom) AS SeqID FROM (SELECT DISTINCT chrom FROM z)), loc AS (SELECT SeqID, s AS \"Offset\", ref AS Base, row_number() OVER (ORDER BY SeqID, s, ref) AS LociID FROM (SELECT DISTINCT SeqID, s, ref FROM z JOIN seq ON seq.SeqName = z.chrom))"


@query("result_loci", _snp + " SELECT LociID, 1 AS ExprID, SeqID, \"Offset\", Base FROM loc")
def result_loci(spark, d):
    return R.snp_tables(snp_sites(spark, d), "run", "target")["TblLoci"]


@query("result_snps", _snp + ", s AS (SELECT CultID, LociID, CAST(sum(qty % 5) AS BIGINT) AS Acnt, CAST(sum(qty) AS BIGINT) AS TotCovCnt, CAST(sum(qty % 6) AS BIGINT) AS TotMMCnt FROM z JOIN cult ON cult.CultName = z.species JOIN seq ON seq.SeqName = z.chrom JOIN loc ON loc.SeqID = seq.SeqID AND loc.\"Offset\" = z.s AND loc.Base = z.ref GROUP BY ALL) SELECT row_number() OVER (ORDER BY CultID, LociID) AS SnpID, CultID, LociID, Acnt, TotCovCnt, TotMMCnt FROM s")
def result_snps(spark, d):
    return R.snp_tables(snp_sites(spark, d), "run", "target")["TblSnps"].select("SnpID", "CultID", "LociID", "Acnt", "TotCovCnt", "TotMMCnt")


@query("result_markers", _snp + " SELECT row_number() OVER (ORDER BY CultID, LociID) AS MarkerID, CultID, LociID, 'T' AS Base, CAST(max(qty) AS INTEGER) AS Score FROM z JOIN cult ON cult.CultName = z.species JOIN seq ON seq.SeqName = z.chrom JOIN loc ON loc.SeqID = seq.SeqID AND loc.\"Offset\" = z.s AND loc.Base = z.ref WHERE qty >= 45 GROUP BY CultID, LociID")
def result_markers(spark, d):
    return R.snp_tables(snp_sites(spark, d), "run", "target")["TblMarkers"].select("MarkerID", "CultID", "LociID", "Base", "Score")


@query("result_bins", with_("loci") + ", t AS (SELECT DISTINCT part FROM loci), k AS (SELECT part, row_number() OVER (ORDER BY lpad(CAST(part AS VARCHAR), 9, '0')) AS TransID FROM t), b AS (SELECT part, s // 500 AS bin, count(*) FILTER (WHERE strand = '+') AS c, count(*) FILTER (WHERE strand = '-') AS x FROM loci GROUP BY ALL) SELECT row_number() OVER (ORDER BY TransID, bin) AS BinID, TransID, TransID AS ExpresID, bin AS NthBin, c AS CtrlCounts, x AS ExprCounts FROM b JOIN k USING (part)")
def result_bins(spark, d):
    l = loci(spark, d).withColumn("TransName", F.lpad(F.col("part").cast("string"), 9, "0"))
    n = lambda k: F.count(F.when(F.col("strand") == k, 1))
    b = l.groupBy("TransName", F.floor(F.col("s") / 500).alias("NthBin")).agg(n("+").alias("CtrlCounts"), n("-").alias("ExprCounts"))
    t = l.groupBy("TransName").agg(F.lit(1).alias("Exons"), F.max("qty").alias("TransLen"), F.lit("").alias("TransAnnotation"), F.count("*").alias("TotCtrlExprCnts"))
    return R.expression_tables(t, b, "run", 6)["TblBins"].select("BinID", "TransID", "ExpresID", "NthBin", "CtrlCounts", "ExprCounts")
