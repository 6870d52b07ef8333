"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..sources.adapters import features, loci, with_

QUERIES, ORACLES = {}, {}


def query(name, oracle):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def islands_sql(keys: str, gap: int, source: str = "loci", count: bool = True) -> str:
    return f"""w AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM {source}),
    f AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e, src ROWS UNBOUNDED PRECEDING) isl FROM w)
    SELECT {keys}, min(s) AS s, max(e) AS e{', count(*) AS n' if count else ''} FROM f GROUP BY {keys}, isl"""


for _name, _keys, _gap in (("merge_islands", ["chrom"], 0), ("merge_islands_stranded", ["chrom", "strand"], 0), ("cluster_maxgap", ["chrom", "strand", "flag"], 7)):
    query(_name, with_("loci") + ", " + islands_sql(", ".join(_keys), _gap))(lambda spark, d, k=_keys, g=_gap: I.merge_islands(loci(spark, d), k, g))

_sets = {"intersect": "a > 0 AND b > 0", "ref_only": "a > 0 AND b = 0", "rel_only": "a = 0 AND b > 0", "union": "a > 0 OR b > 0"}
_sweep = """ev AS (SELECT chrom, flag, s AS p, (strand = '+')::INT AS a, (strand = '-')::INT AS b FROM loci UNION ALL SELECT chrom, flag, e + 1, -(strand = '+')::INT, -(strand = '-')::INT FROM loci),
 g AS (SELECT chrom, flag, p, sum(a) AS a, sum(b) AS b FROM ev GROUP BY ALL),
 seg AS (SELECT chrom, flag, p AS s, lead(p) OVER w - 1 AS e, sum(a) OVER w AS a, sum(b) OVER w AS b, p AS src FROM g WINDOW w AS (PARTITION BY chrom, flag ORDER BY p)),
 kept AS (SELECT * FROM seg WHERE {})"""
for _name, _cond in _sets.items():
    query(f"setop_{_name}", with_("loci", then=_sweep.format(_cond)) + ", " + islands_sql("chrom, flag", 0, "kept", False))(
        lambda spark, d, m=_name: I.set_operation(loci(spark, d), ["chrom", "flag"], F.col("strand") == "+", F.col("strand") == "-", m)
    )


@query("setop_neither", with_("loci", then="i AS (" + "WITH " + islands_sql("chrom, flag", 0, count=False) + "), n AS (SELECT chrom, flag, e + 1 AS s, lead(s) OVER (PARTITION BY chrom, flag ORDER BY s) - 1 AS e FROM i)") + " SELECT * FROM n WHERE e IS NOT NULL")
def setop_neither(spark, d):
    return I.neither(loci(spark, d), ["chrom", "flag"])


@query("coverage_sweep", with_("loci", then=_sweep.format("a > 0 OR b > 0")) + " SELECT chrom, flag, s, e, a AS sense, b AS antisense FROM kept")
def coverage_sweep(spark, d):
    return I.depth_segments(loci(spark, d), ["chrom", "flag"], {"sense": F.col("strand") == "+", "antisense": F.col("strand") == "-"}).select("chrom", "flag", "s", "e", "sense", "antisense")


@query("roi_regions", with_("loci", then=_sweep.format("a + b >= 3")) + ", " + islands_sql("chrom, flag", 4, "kept", False).replace("max(e) AS e", "max(e) AS e, sum((a + b) * (e - s + 1)) AS bases"))
def roi_regions(spark, d):
    """Regions with depth 3 or more, gaps of up to 4 bridged, and the bases that cover them."""
    seg = I.depth_segments(loci(spark, d), ["chrom", "flag"], {"a": F.col("strand") == "+", "b": F.col("strand") == "-"}).filter("a + b >= 3")
    covering = (F.col("a") + F.col("b")) * (F.col("e") - F.col("s") + 1)
    return I.merge_islands(seg, ["chrom", "flag"], 4, {"bases": covering}).select("chrom", "flag", "s", "e", "bases")


_pair = "l.chrom = r.chrom AND l.s <= r.e AND l.e >= r.s"


@query("overlap_pairs", with_("loci", "features") + f" SELECT l.src, r.name, least(l.e, r.e) - greatest(l.s, r.s) + 1 AS bases FROM loci l JOIN features r ON {_pair}")
def overlap_pairs(spark, d):
    p = I.overlap_join(loci(spark, d), features(spark, d))
    return p.select("src", F.col("r_name").alias("name"), (F.least("e", "r_e") - F.greatest("s", "r_s") + 1).alias("bases"))


for _name, _anti in (("overlap_semi", False), ("overlap_anti", True)):
    query(_name, with_("loci", "features") + f" SELECT src, chrom, s, e FROM loci l WHERE {'NOT ' * _anti}EXISTS (SELECT 1 FROM features r WHERE {_pair})")(
        lambda spark, d, a=_anti: I.overlap_any(loci(spark, d), features(spark, d), a).select("src", "chrom", "s", "e")
    )


@query("dropouts", with_("loci", "features") + f" SELECT flag, count(*) AS n, CAST(sum(e - s + 1) AS BIGINT) AS bases FROM loci l WHERE NOT EXISTS (SELECT 1 FROM features r WHERE {_pair}) GROUP BY flag")
def dropouts(spark, d):
    return I.overlap_any(loci(spark, d), features(spark, d), anti=True).groupBy("flag").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s") + 1).alias("bases"))


@query("feature_counts", with_("loci", "features") + f" SELECT r.cls, count(*) AS hits, count(DISTINCT r.name) AS features, count(DISTINCT l.src) AS loci FROM loci l JOIN features r ON {_pair} GROUP BY r.cls")
def feature_counts(spark, d):
    p = I.overlap_join(loci(spark, d), features(spark, d)).select(F.col("r_cls").alias("cls"), "src", F.col("r_name").alias("name"))
    return p.groupBy("cls").agg(F.count("*").alias("hits"), F.countDistinct("name").alias("features"), F.countDistinct("src").alias("loci"))


_ref = """ev AS (SELECT chrom, s AS p, 1 AS a, 0 AS b FROM loci UNION ALL SELECT chrom, e + 1, -1, 0 FROM loci UNION ALL SELECT chrom, s, 0, 1 FROM features UNION ALL SELECT chrom, e + 1, 0, -1 FROM features),
 g AS (SELECT chrom, p, sum(a) AS a, sum(b) AS b FROM ev GROUP BY ALL),
 seg AS (SELECT chrom, p AS s, lead(p) OVER w - 1 AS e, sum(a) OVER w AS a, sum(b) OVER w AS b, p AS src FROM g WINDOW w AS (PARTITION BY chrom ORDER BY p)),
 kept AS (SELECT * FROM seg WHERE a > 0 AND b = 0)"""


@query("ref_unique_segments", with_("loci", "features", then=_ref) + ", " + islands_sql("chrom", 0, "kept", False))
def ref_unique_segments(spark, d):
    """Stretches of loci that no feature covers; chromosomes without features count."""
    a = loci(spark, d).select("chrom", "s", "e", F.lit(True).alias("ref"))
    return I.set_operation(a.unionByName(features(spark, d).select("chrom", "s", "e", F.lit(False).alias("ref"))), ["chrom"], F.col("ref"), ~F.col("ref"), "ref_only")


@query("nearest_upstream", with_("loci", "features", then="e AS (SELECT DISTINCT chrom, e FROM features)") + " SELECT src, CAST(l.s - e.e - 1 AS BIGINT) AS dist FROM loci l ASOF LEFT JOIN e ON l.chrom = e.chrom AND l.s > e.e")
def nearest_upstream(spark, d):
    return I.nearest_upstream(loci(spark, d), features(spark, d)).select("src", "dist")


@query("nearest_downstream", with_("loci", "features", then="e AS (SELECT DISTINCT chrom, s FROM features)") + " SELECT src, CAST(e.s - l.e - 1 AS BIGINT) AS dist FROM loci l ASOF LEFT JOIN e ON l.chrom = e.chrom AND l.e < e.s")
def nearest_downstream(spark, d):
    return I.nearest_downstream(loci(spark, d), features(spark, d)).select("src", "dist")


_bits = "b AS (SELECT l.src, bit_or((CASE WHEN l.s <= r.e AND l.e >= r.s THEN 1 ELSE 0 END) | (CASE WHEN l.s < r.s THEN 16 ELSE 0 END) | (CASE WHEN l.e > r.e THEN 32 ELSE 0 END)) AS bits FROM loci l JOIN features r ON l.chrom = r.chrom AND l.s <= r.e + 20 AND l.e >= r.s - 20 GROUP BY l.src), x AS (SELECT l.src, l.flag, coalesce(b.bits, 0)::INT AS bits FROM loci l LEFT JOIN b ON l.src = b.src)"


@query("region_bits", with_("loci", "features", then=_bits) + " SELECT src, bits FROM x")
def region_bits(spark, d):
    return I.region_bits(loci(spark, d), features(spark, d), 20)


@query("region_priority_counts", with_("loci", "features", then=_bits) + " SELECT flag, CASE WHEN bits & 1 > 0 THEN 'inside' WHEN bits & 16 > 0 THEN 'upstream' WHEN bits & 32 > 0 THEN 'downstream' ELSE 'intergenic' END AS region, count(*) AS n FROM x GROUP BY ALL")
def region_priority_counts(spark, d):
    b = I.region_bits(loci(spark, d), features(spark, d), 20, ["flag"])
    bit = lambda k: F.col("bits").bitwiseAND(k) > 0
    region = F.when(bit(I.CDS), "inside").when(bit(I.UPSTREAM), "upstream").when(bit(I.DOWNSTREAM), "downstream").otherwise("intergenic")
    return b.groupBy("flag", region.alias("region")).agg(F.count("*").alias("n"))


_near = "w AS (SELECT *, max(e) OVER (PARTITION BY chrom, flag ORDER BY s, e, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe, min(s) OVER (PARTITION BY chrom, flag ORDER BY s, e, src ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM loci)"
for _name, _cond in (("overlapped_only", "coalesce(s <= pe, false) OR coalesce(e >= ns, false)"), ("non_overlapped", "coalesce(s > pe, true) AND coalesce(e < ns, true)")):

    def _self(spark, d, overlapped=_name == "overlapped_only"):
        keys = ["chrom", "flag"]
        k = loci(spark, d)
        alone = I.depth_segments(k, keys, {"n": F.lit(True)}).filter("n > 1").select(F.concat_ws("|", *keys).alias("chrom"), "s", "e")
        return I.overlap_any(k.withColumn("chrom", F.concat_ws("|", *keys)), alone, anti=not overlapped).select("src", "s", "e")

    query(_name, with_("loci", then=_near) + f" SELECT src, s, e FROM w WHERE {_cond}")(_self)


@query("extend_flanks", with_("loci") + " SELECT src, chrom, greatest(s - 10, 0) AS s, e + 10 AS e FROM loci")
def extend_flanks(spark, d):
    return loci(spark, d).select("src", "chrom", F.greatest(F.col("s") - 10, F.lit(0)).alias("s"), (F.col("e") + 10).alias("e"))


@query("overlap_fraction", with_("loci", "features", then=f"m AS (SELECT * FROM (WITH {islands_sql('chrom', 0, '(SELECT *, name AS src FROM features)', False)}))") + f" SELECT l.src, CAST(sum(least(l.e, r.e) - greatest(l.s, r.s) + 1) * 1000 // any_value(l.e - l.s + 1) AS BIGINT) AS permille FROM loci l JOIN m r ON {_pair} GROUP BY l.src, l.s, l.e")
def overlap_fraction(spark, d):
    """Thousandths of each locus that features cover."""
    p = I.overlap_join(loci(spark, d), I.merge_islands(features(spark, d), ["chrom"], 0))
    bases = F.sum(F.least("e", "r_e") - F.greatest("s", "r_s") + 1)
    return p.groupBy("src", "s", "e").agg(F.floor(bases * 1000 / F.max(F.col("e") - F.col("s") + 1)).alias("permille")).select("src", "permille")
