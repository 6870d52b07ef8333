"""Queries of the table, sequence and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import reads as R, tables as T
from ..sources.adapters import loci, matrix, series, with_
from ..sources.storage import table

QUERIES, ORACLES = {}, {}


def query(name, oracle):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


_conj = "chrom % 3 <> 0 AND strand = '+' AND e - s + 1 BETWEEN 5 AND 40 AND flag IN ('A', 'N')"


@query("csvfilter_all", with_("loci") + f" SELECT src, chrom, s, e FROM loci WHERE {_conj}")
def csvfilter_all(spark, d):
    return loci(spark, d).filter(_conj).select("src", "chrom", "s", "e")


@query("reject_reasons", with_("loci") + " SELECT CASE WHEN chrom % 3 = 0 THEN 'chrom' WHEN strand <> '+' THEN 'strand' WHEN e - s + 1 NOT BETWEEN 5 AND 40 THEN 'length' WHEN flag NOT IN ('A', 'N') THEN 'flag' ELSE 'accepted' END AS reason, count(*) AS n FROM loci GROUP BY 1")
def reject_reasons(spark, d):
    reason = F.when(F.expr("chrom % 3 = 0"), "chrom").when(F.expr("strand <> '+'"), "strand").when(~F.expr("e - s + 1 BETWEEN 5 AND 40"), "length").when(~F.col("flag").isin("A", "N"), "flag").otherwise("accepted")
    return loci(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("nxx", "WITH l AS (SELECT n_chars AS len FROM documents WHERE n_chars > 0), c AS (SELECT len, sum(len) OVER (ORDER BY len DESC RANGE UNBOUNDED PRECEDING) AS upto, count(*) OVER (ORDER BY len DESC RANGE UNBOUNDED PRECEDING) AS n, sum(len) OVER () AS total FROM l) SELECT p AS nxx, max(len) AS length, arg_max(n, len) AS n FROM c, (VALUES (25), (50), (75), (90)) v(p) WHERE upto * 100 >= total * p GROUP BY p")
def nxx(spark, d):
    return T.nxx(table(spark, d, "documents").select(F.col("n_chars").alias("len")), [25, 50, 75, 90])


@query("length_hist", "SELECT lang, CAST(n_chars // 250 * 250 AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY ALL")
def length_hist(spark, d):
    return table(spark, d, "documents").groupBy("lang", (F.floor(F.col("n_chars") / 250) * 250).alias("bin")).agg(F.count("*").alias("n"))


_cls = "CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END"


@query("length_class_rollup", f"SELECT lang, cls, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT lang, {_cls} AS cls, n_chars FROM documents) GROUP BY ROLLUP (lang, cls)")
def length_class_rollup(spark, d):
    return table(spark, d, "documents").select("lang", F.expr(_cls).alias("cls"), "n_chars").rollup("lang", "cls").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("class_pct", f"SELECT lang, cls, n, round(n * 100.0 / sum(n) OVER (PARTITION BY lang), 4) AS pct FROM (SELECT lang, {_cls} AS cls, count(*) AS n FROM documents GROUP BY ALL)")
def class_pct(spark, d):
    c = table(spark, d, "documents").groupBy("lang", F.expr(_cls).alias("cls")).agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("lang")), 4))


_km = "km AS (SELECT lang, substr(lower(text), CAST(i AS BIGINT), 3) AS kmer FROM documents, LATERAL (SELECT unnest(range(1, length(text) - 1)) AS i) t)"


def _texts(spark, d):
    return table(spark, d, "documents").select("lang", F.lower("text").alias("text"))


@query("kmer_counts", f"WITH {_km} SELECT lang, kmer, count(*) AS n FROM km GROUP BY ALL")
def kmer_counts(spark, d):
    return T.kmer_counts(_texts(spark, d), 3, ["lang"])


@query("kmer_unique_by_group", f"WITH {_km} SELECT kmer, min(lang) AS lang, count(*) AS n FROM km GROUP BY kmer HAVING count(DISTINCT lang) = 1")
def kmer_unique_by_group(spark, d):
    c = T.kmer_counts(_texts(spark, d), 3, ["lang"])
    return c.groupBy("kmer").agg(F.min("lang").alias("lang"), F.sum("n").alias("n"), F.count("*").alias("g")).filter("g = 1").drop("g")


@query("kmer_shared", f"WITH {_km} SELECT kmer, count(DISTINCT lang) AS langs, count(*) AS n FROM km GROUP BY kmer HAVING count(DISTINCT lang) >= 3")
def kmer_shared(spark, d):
    c = T.kmer_counts(_texts(spark, d), 3, ["lang"])
    return c.groupBy("kmer").agg(F.count("*").alias("langs"), F.sum("n").alias("n")).filter("langs >= 3")


@query("base_composition", "SELECT lang, " + ", ".join(f"CAST(sum(length(text) - length(replace(lower(text), '{b}', ''))) AS BIGINT) AS n_{b}" for b in "acgt") + " FROM documents GROUP BY lang")
def base_composition(spark, d):
    t = table(spark, d, "documents")
    return t.groupBy("lang").agg(*[F.sum(F.char_length("text") - F.char_length(F.replace(F.lower("text"), F.lit(b), F.lit("")))).alias(f"n_{b}") for b in "acgt"])


@query("dedupe_exact", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def dedupe_exact(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return t.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1").drop("h")


@query("reverse_complement", "SELECT doc_id, md5(array_to_string(list_reverse(string_split(translate(text, 'ACGTacgt', 'TGCAtgca'), '')), '')) AS rc FROM documents")
def reverse_complement(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.complement(F.col("text"))).alias("rc"))


@query("pivot_counts_complete", "SELECT l_suppkey AS chrom, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1 HAVING a > 0 AND n > 0 AND r > 0")
def pivot_counts_complete(spark, d):
    n = {k: F.count(F.when(F.col("flag") == k, 1)).alias(k.lower()) for k in "ANR"}
    return loci(spark, d).groupBy("chrom").agg(*n.values()).filter("a > 0 and n > 0 and r > 0")


@query("rpkm", with_("loci", then="g AS (SELECT flag, part, count(*) AS reads, CAST(sum(qty) AS BIGINT) AS bases FROM loci GROUP BY ALL)") + " SELECT flag, part, reads, round(reads * 1e9 / (bases * sum(reads) OVER (PARTITION BY flag)), 4) AS rpkm FROM g")
def rpkm(spark, d):
    g = loci(spark, d).groupBy("flag", "part").agg(F.count("*").alias("reads"), F.sum("qty").alias("bases"))
    total = g.groupBy("flag").agg(F.sum("reads").alias("total"))
    return g.join(F.broadcast(total), "flag").select("flag", "part", "reads", F.round(F.col("reads") * F.lit(1e9) / (F.col("bases") * F.col("total")), 4).alias("rpkm"))


@query("best_isoform", with_("loci", then="g AS (SELECT chrom, part, count(*) AS reads, CAST(sum(qty) AS BIGINT) AS bases FROM loci GROUP BY ALL)") + " SELECT chrom, part, reads, bases FROM g QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY bases DESC, part) = 1")
def best_isoform(spark, d):
    g = loci(spark, d).groupBy("chrom", "part").agg(F.count("*").alias("reads"), F.sum("qty").alias("bases"))
    return T.top_per_group(g, ["chrom"], [F.desc("bases"), F.col("part")], 1).drop("rank")


@query("libnorm", with_("loci", then="g AS (SELECT flag, chrom, count(*) AS n FROM loci GROUP BY ALL), t AS (SELECT flag, sum(n) AS t FROM g GROUP BY flag)") + " SELECT flag, chrom, round(n * (SELECT max(t) FROM t) / t.t, 4) AS norm FROM g JOIN t USING (flag)")
def libnorm(spark, d):
    g = loci(spark, d).groupBy("flag", "chrom").agg(F.count("*").alias("n"))
    t = g.groupBy("flag").agg(F.sum("n").alias("t"))
    top = t.agg(F.max("t").alias("top"))
    return g.join(F.broadcast(t), "flag").join(F.broadcast(top)).select("flag", "chrom", F.round(F.col("n") * F.col("top") / F.col("t"), 4).alias("norm"))


@query("pcr_reduce", with_("series") + ", x AS (SELECT *, count(*) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS n FROM series) SELECT chrom, pos, event_id FROM x WHERE n <= 2")
def pcr_reduce(spark, d):
    """Events that at most one other event of 600 seconds before shares."""
    w = Window.partitionBy("chrom").orderBy("pos").rangeBetween(-600, 0)
    return series(spark, d).withColumn("n", F.count("*").over(w)).filter("n <= 2").select("chrom", "pos", "event_id")


for _name, _count in (("tumbling_all", "count(*)"), ("tumbling_unique", "count(DISTINCT pos)")):
    query(_name, with_("series") + f" SELECT chrom, CAST(pos // 86400 AS BIGINT) AS bin, {_count} AS n, CAST(sum(cents) AS BIGINT) AS cents FROM series GROUP BY 1, 2")(
        lambda spark, d, u=_name == "tumbling_unique": series(spark, d).groupBy("chrom", F.floor(F.col("pos") / 86400).alias("bin")).agg((F.countDistinct("pos") if u else F.count("*")).alias("n"), F.sum("cents").alias("cents"))
    )


@query("smooth3", with_("series") + ", b AS (SELECT event_type, CAST(pos // 86400 AS BIGINT) AS bin, count(*) AS n FROM series GROUP BY 1, 2) SELECT event_type, bin, CAST((coalesce(lag(n) OVER w, n) + n + coalesce(lead(n) OVER w, n)) // 3 AS BIGINT) AS n3 FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bin)")
def smooth3(spark, d):
    b = series(spark, d).groupBy("event_type", F.floor(F.col("pos") / 86400).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("bin")
    return b.select("event_type", "bin", F.floor((F.coalesce(F.lag("n").over(w), "n") + F.col("n") + F.coalesce(F.lead("n").over(w), "n")) / 3).alias("n3"))


@query("moving_avg", with_("series") + " SELECT event_id, CAST(floor(sum(cents) OVER w / count(*) OVER w) AS BIGINT) AS smooth FROM series WINDOW w AS (PARTITION BY chrom ORDER BY pos, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
def moving_avg(spark, d):
    return T.moving_average(series(spark, d), ["chrom"], ["pos", "event_id"], "cents", 4).select("event_id", "smooth")


@query("baseline", with_("series") + " SELECT event_id, cents - min(cents) OVER (PARTITION BY chrom ORDER BY pos, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS above FROM series")
def baseline(spark, d):
    w = Window.partitionBy("chrom").orderBy("pos", "event_id").rowsBetween(-10, 10)
    return series(spark, d).select("event_id", (F.col("cents") - F.min("cents").over(w)).alias("above"))


@query("lag_distance_stats", with_("series") + ", x AS (SELECT event_type, pos - lag(pos) OVER (PARTITION BY event_type, chrom ORDER BY pos, event_id) AS gap FROM series) SELECT event_type, count(*) AS n, min(gap) AS least, max(gap) AS most, round(avg(gap), 4) AS mean FROM x WHERE gap IS NOT NULL GROUP BY event_type")
def lag_distance_stats(spark, d):
    w = Window.partitionBy("event_type", "chrom").orderBy("pos", "event_id")
    x = series(spark, d).select("event_type", (F.col("pos") - F.lag("pos").over(w)).alias("gap")).filter("gap is not null")
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.round(F.avg("gap"), 4).alias("mean"))


@query("rle_spans", with_("loci") + ", c AS (SELECT DISTINCT chrom, s AS p, (flag = 'N')::INT AS v FROM loci QUALIFY row_number() OVER (PARTITION BY chrom, s ORDER BY src) = 1), x AS (SELECT *, CASE WHEN lag(v) OVER w = v AND lag(p) OVER w = p - 1 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY chrom ORDER BY p)), r AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY p) AS run FROM x) SELECT chrom, v, min(p) AS s, max(p) AS e FROM r GROUP BY chrom, run, v")
def rle_spans(spark, d):
    first = loci(spark, d).groupBy("chrom", F.col("s").alias("p")).agg(F.min_by(F.when(F.col("flag") == "N", 1).otherwise(0), "src").alias("v"))
    return T.spans(first, ["chrom"], "p", "v")


_groups = "m AS (SELECT label, col, CAST(sum(v) AS BIGINT) AS v FROM matrix GROUP BY ALL)"


@query("pearson_pairs", with_("matrix", then=_groups) + " SELECT a.label AS x, b.label AS y, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM m a JOIN m b ON a.col = b.col AND a.label < b.label GROUP BY ALL")
def pearson_pairs(spark, d):
    """Correlation of the summed profiles of every two labels: labels are few, rows are summed first."""
    m = matrix(spark, d).groupBy("label", "col").agg(F.sum("v").alias("v"))
    a, b = m.select("col", F.col("label").alias("x"), F.col("v").alias("a")), m.select("col", F.col("label").alias("y"), F.col("v").alias("b"))
    return T.pearson(a.join(b, "col").filter("x < y"), ["x", "y"], "a", "b")


@query("unpivot_melt", with_("matrix") + " SELECT row, col, v FROM matrix")
def unpivot_melt(spark, d):
    return matrix(spark, d).select("row", "col", "v")


@query("transpose_sums", with_("matrix") + " SELECT col, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most FROM matrix GROUP BY col")
def transpose_sums(spark, d):
    return matrix(spark, d).groupBy("col").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))


@query("consensus_mode", with_("matrix") + ", c AS (SELECT label, col, v > 0 AS up, count(*) AS n, min(row) AS f FROM matrix GROUP BY ALL) SELECT label, col, CAST(up AS INT) AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY label, col ORDER BY n DESC, f) = 1")
def consensus_mode(spark, d):
    """Most frequent sign of each group and column; of equals the one seen first."""
    c = matrix(spark, d).groupBy("label", "col", (F.col("v") > 0).cast("int").alias("mode")).agg(F.count("*").alias("n"), F.min("row").alias("f"))
    return T.top_per_group(c, ["label", "col"], [F.desc("n"), F.col("f")], 1).drop("rank", "f")


@query("concordance", with_("matrix") + ", c AS (SELECT label, col, count(*) AS n, count(*) FILTER (WHERE v > 0) AS up FROM matrix GROUP BY ALL) SELECT label, round(sum(greatest(up, n - up)) / sum(n), 6) AS concordance FROM c GROUP BY label")
def concordance(spark, d):
    c = matrix(spark, d).groupBy("label", "col").agg(F.count("*").alias("n"), F.count(F.when(F.col("v") > 0, 1)).alias("up"))
    return c.groupBy("label").agg(F.round(F.sum(F.greatest("up", F.col("n") - F.col("up"))) / F.sum("n"), 6).alias("concordance"))


@query("fmeasure_groups", with_("matrix") + ", c AS (SELECT label, col, count(*) FILTER (WHERE v > 0) AS tp, count(*) FILTER (WHERE v <= 0) AS fn FROM matrix GROUP BY ALL), t AS (SELECT col, sum(tp) AS up FROM c GROUP BY col) SELECT label, c.col, tp, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fn + (up - tp)) END, 6) AS f1 FROM c JOIN t ON c.col = t.col")
def fmeasure_groups(spark, d):
    c = matrix(spark, d).groupBy("label", "col").agg(F.count(F.when(F.col("v") > 0, 1)).alias("tp"), F.count(F.when(F.col("v") <= 0, 1)).alias("fn"))
    t = c.groupBy("col").agg(F.sum("tp").alias("up"))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fn") + F.col("up") - F.col("tp")))
    return c.join(t, "col").select("label", "col", "tp", F.round(f1, 6).alias("f1"))


@query("chi2_2x2", with_("loci") + ", c AS (SELECT chrom, count(*) FILTER (WHERE strand = '+' AND flag = 'N') AS a, count(*) FILTER (WHERE strand = '+' AND flag <> 'N') AS b, count(*) FILTER (WHERE strand <> '+' AND flag = 'N') AS c, count(*) FILTER (WHERE strand <> '+' AND flag <> 'N') AS d FROM loci GROUP BY chrom) SELECT chrom, round(CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) = 0 THEN 0 ELSE CAST(a + b + c + d AS DOUBLE) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d)) / ((a + c) * (b + d)) END, 6) AS chi2 FROM c")
def chi2_2x2(spark, d):
    count = lambda s, n: F.count(F.when((F.col("strand") == "+" if s else F.col("strand") != "+") & (F.col("flag") == "N" if n else F.col("flag") != "N"), 1))
    c = loci(spark, d).groupBy("chrom").agg(count(1, 1).alias("a"), count(1, 0).alias("b"), count(0, 1).alias("c"), count(0, 0).alias("d"))
    return c.select("chrom", F.round(F.expr("CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) = 0 THEN 0D ELSE CAST(a + b + c + d AS DOUBLE) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d)) / ((a + c) * (b + d)) END"), 6).alias("chi2"))


_p = "p AS (SELECT part AS id, CAST(count(*) FILTER (WHERE flag = 'N') AS DOUBLE) / (count(*) * 50) AS p FROM loci GROUP BY part), r AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM p)"
for _name, _factor in (("bonferroni", "m"), ("holm", "(m - r + 1)"), ("bh", "(m / r)")):

    def _correct(spark, d, method=_name):
        p = loci(spark, d).groupBy(F.col("part").alias("id")).agg((F.count(F.when(F.col("flag") == "N", 1)).cast("double") / (F.count("*") * 50)).alias("p"))
        return T.corrected(p, method).select("id", F.round("p", 9).alias("p"), F.round("adj", 6).alias("adj"))

    query(_name, with_("loci", then=_p) + f" SELECT id, round(p, 9) AS p, round(least(p * {_factor}, 1.0), 6) AS adj FROM r")(_correct)


for _name, _having in (("set_union", "max(f) + max(o) > 0"), ("set_intersect", "max(f) = 1 AND max(o) = 1"), ("set_subtract", "max(f) = 1 AND max(o) = 0"), ("set_symmetric", "max(f) <> max(o)")):

    def _set(spark, d, having=_having):
        o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("f"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("o"))
        g = o.groupBy("o_custkey").agg(F.max("f").alias("f"), F.max("o").alias("o"))
        return g.filter(having.replace("max(f)", "f").replace("max(o)", "o")).select("o_custkey")

    query(_name, f"SELECT o_custkey FROM (SELECT o_custkey, (o_orderstatus = 'F')::INT AS f, (o_orderstatus = 'O')::INT AS o FROM orders) GROUP BY o_custkey HAVING {_having}")(_set)


@query("topn_resort", with_("loci") + ", t AS (SELECT * FROM loci ORDER BY qty DESC, src LIMIT 500) SELECT src, chrom, s, qty FROM t")
def topn_resort(spark, d):
    """The 500 longest loci: the limit is the feature."""
    return loci(spark, d).orderBy(F.desc("qty"), "src").limit(500).select("src", "chrom", "s", "qty").orderBy("chrom", "s", "src")


@query("itemset_support", "WITH i AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT a.b AS x, b.b AS y, count(*) AS support FROM i a JOIN i b ON a.o = b.o AND a.b < b.b GROUP BY ALL")
def itemset_support(spark, d):
    """Orders in which two brands occur together; an order has few lines, so its pairs are few."""
    i = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o"), F.col("p_brand").alias("b"))
    g = i.groupBy("o").agg(F.array_sort(F.collect_set("b")).alias("bs"))
    pair = F.flatten(F.transform("bs", lambda x: F.transform(F.filter("bs", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return g.select(F.explode(pair).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("support"))


@query("link_counts", "WITH t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT role, next, count(*) AS n FROM t WHERE next IS NOT NULL GROUP BY ALL")
def link_counts(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("role", F.lead("role").over(w).alias("next")).filter("next is not null").groupBy("role", "next").agg(F.count("*").alias("n"))


@query("ontology_closure", "SELECT r_name AS term, count(DISTINCT n_nationkey) AS children, count(c_custkey) AS genes FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name UNION ALL SELECT n_name, 0, count(c_custkey) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def ontology_closure(spark, d):
    """Genes annotated to each term or to a term below it."""
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("genes"))
    n = table(spark, d, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    r = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy(F.col("r_name").alias("term")).agg(F.count("n_nationkey").alias("children"), F.coalesce(F.sum("genes"), F.lit(0)).alias("genes"))
    return r.unionByName(n.select(F.col("n_name").alias("term"), F.lit(0).cast("long").alias("children"), F.coalesce("genes", F.lit(0)).alias("genes")))


@query("phred_hist", "SELECT CAST(i - 1 AS BIGINT) AS at, unicode(c) % 41 AS q, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) > 0) GROUP BY ALL")
def phred_hist(spark, d):
    """How often each offset in a read has each quality (code points mod 41)."""
    return R.quality_histogram(table(spark, d, "documents").select(F.col("text").alias("qual")), lambda c: F.ascii(c) % 41)


@query("prob_error_free", "SELECT doc_id, round(sum(ln(1 - pow(10, -(unicode(c) % 40 + 5) / 10.0))), 4) AS log_p FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0) GROUP BY doc_id")
def prob_error_free(spark, d):
    """Log of the chance that all bases of a read are right, with code points as qualities (mod 40, plus 5)."""
    t = table(spark, d, "documents").filter("char_length(text) > 0")
    return t.select("doc_id", F.round(R.log_error_free(F.col("text"), lambda c: F.ascii(c) % 40 + 5), 4).alias("log_p"))


@query("feature_length_quantiles", with_("features", "loci") + " SELECT flag, count(*) AS n, min(qty) AS q0, quantile_disc(qty, 0.5) AS q50, max(qty) AS q100 FROM loci GROUP BY flag")
def feature_length_quantiles(spark, d):
    c = loci(spark, d).groupBy("flag", "qty").agg(F.count("*").alias("k"))
    w = Window.partitionBy("flag").orderBy("qty")
    c = c.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("flag")))
    return c.groupBy("flag").agg(F.max("n").alias("n"), F.min("qty").alias("q0"), F.min(F.when(F.col("upto") * 2 >= F.col("n"), F.col("qty"))).alias("q50"), F.max("qty").alias("q100"))


