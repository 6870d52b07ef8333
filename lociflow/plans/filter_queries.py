"""Queries of filters, remapping, profiles and alignment columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as L, remap as M, search as S
from ..sources import tables as T
from ..sources.adapters import features, genes, loci, series, with_
from ..sources.storage import table

QUERIES, ORACLES = {}, {}


def query(name, oracle):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def elements(spark, d):
    """Loci with what the filter's rules look at."""
    q = F.col("qty")
    return loci(spark, d).withColumns({"chrom": F.concat(F.lit("chr"), F.col("chrom").cast("string")), "species": F.col("flag"), "score": (F.col("part") % 100).cast("double"), "matches": q - q % 7, "mismatches": q % 7, "bits": F.expr("shiftleft(1, CAST(part % 6 AS INT))"), "len": q})


_elements = with_("loci", "features") + ", el AS (SELECT src, 'chr' || chrom AS chrom, s, e, strand, flag, flag AS species, part, qty, part % 100 AS score, qty - qty % 7 AS matches, qty % 7 AS mismatches, 1 << (part % 6) AS bits FROM loci), fe AS (SELECT 'chr' || chrom AS chrom, s, e, name FROM features WHERE cls = '1-URGENT')"
_reason = """CASE WHEN src % 11 = 0 THEN 'exclude_ids' WHEN e - s + 1 < 5 THEN 'short' WHEN e - s + 1 > 45 THEN 'long' WHEN lower(species) NOT IN ('a', 'n') THEN 'species'
 WHEN regexp_matches(chrom, '(?i)^CHR.*3$') OR NOT (regexp_matches(chrom, '(?i)chr[1-5]') OR regexp_matches(chrom, '(?i)0$')) THEN 'chrom' WHEN strand <> '+' THEN 'strand' WHEN score < 10 THEN 'low_score' WHEN score > 90 THEN 'high_score'
 WHEN EXISTS (SELECT 1 FROM fe WHERE fe.chrom = el.chrom AND el.s <= fe.e AND el.e >= fe.s) THEN 'exclude_loci' WHEN bits & 27 = 0 THEN 'regions' WHEN bits & 2 > 0 THEN 'no_regions' WHEN matches + mismatches < 6 THEN 'aligned' WHEN 100.0 * matches < 80 * (matches + mismatches) THEN 'identity' END"""


def rules(spark, d) -> L.ElementFilter:
    el = elements(spark, d)
    fe = features(spark, d).filter("cls = '1-URGENT'").withColumn("chrom", F.concat(F.lit("chr"), F.col("chrom").cast("string")))
    return L.ElementFilter(
        exclude_ids=el.filter("src % 11 = 0").select("src"), least_length=5, most_length=45, species=["A", "N"], include_chroms=["chr[1-5]", "0$"], exclude_chroms=["^CHR.*3$"], strand="+", least_score=10, most_score=90,
        exclude_loci=fe, regions=27, no_regions=L.region_mask("5UTR"), least_aligned=6, least_identity=80.0,
    )


@query("element_reasons", _elements + f" SELECT coalesce({_reason}, 'accepted') AS reason, count(*) AS n FROM el GROUP BY 1")
def element_reasons(spark, d):
    return rules(spark, d).reasons(elements(spark, d)).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("element_filter", _elements + f" SELECT src, chrom, s, e FROM el WHERE {_reason} IS NULL")
def element_filter(spark, d):
    return L.projection(rules(spark, d).kept(elements(spark, d)).select("src", "chrom", "strand", "s", "e"), "1-2,4-5")


@query("element_filter_loci", _elements + " SELECT src FROM el WHERE EXISTS (SELECT 1 FROM fe WHERE fe.chrom = el.chrom AND el.s <= fe.e AND el.e >= fe.s) AND src IN (SELECT src FROM el WHERE part % 3 = 0)")
def element_filter_loci(spark, d):
    el, r = elements(spark, d), rules(spark, d)
    return L.ElementFilter(include_loci=r.exclude_loci, include_ids=el.filter("part % 3 = 0").select("src")).kept(el).select("src")


@query("alone_elements", with_("loci") + ", w AS (SELECT *, max(e) OVER (PARTITION BY chrom, flag ORDER BY s, e, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe, min(s) OVER (PARTITION BY chrom, flag ORDER BY s, e, src ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM loci) SELECT src, chrom FROM w WHERE coalesce(s > pe, true) AND coalesce(e < ns, true)")
def alone_elements(spark, d):
    return L.alone_or_not(loci(spark, d), ["chrom", "flag"], False).select("src", "chrom")


@query("flagged_features", with_("features") + " SELECT name, cls FROM (SELECT *, CASE WHEN name % 5 = 0 THEN 4 ELSE 0 END | CASE WHEN name % 3 = 0 THEN 2 ELSE 0 END AS flags FROM features) WHERE flags & 4 = 4 AND flags & 2 = 0")
def flagged_features(spark, d):
    f = features(spark, d).withColumn("name", F.col("name").cast("string"))
    f = L.flagged(L.flagged(f, f.filter("name % 5 = 0").select("name"), 4), f.filter("name % 3 = 0").select("name"), 2)
    return L.by_flags(f, 4, 2).select(F.col("name").cast("bigint").alias("name"), "cls")


@query("typed_features", "SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND regexp_matches(props, '^..k.: [1-4]')")
def typed_features(spark, d):
    t = table(spark, d, "events").select("event_id", F.col("event_type").alias("type"), F.create_map(F.lit("note"), F.col("props")).alias("attributes"))
    return L.features_of(t, ["CLICK", "purchase"], "note", "^..k.: [1-4]").select("event_id")


@query("prefixed_names", "SELECT p_partkey, 'x|' || p_name AS name FROM part WHERE starts_with(p_name, 'small')")
def prefixed_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    return L.with_prefix(L.with_prefix(L.of_prefix(p, "name", "small"), "name", "small"), "name", "x|")


@query("unique_names", "SELECT p_partkey, CASE WHEN k > 1 THEN p_name || '.' || k ELSE p_name END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def unique_names(spark, d):
    return L.unique_names(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), "name", ["p_partkey"])


@query("without_long_unknown", "SELECT doc_id FROM documents WHERE coalesce(NOT regexp_matches(text, '(?i)N{3,}'), true)")
def without_long_unknown(spark, d):
    return L.without_long_unknown(table(spark, d, "documents").withColumn("seq", F.col("text")), 2).select("doc_id")


@query("extracted", "SELECT p_partkey, translate(reverse(substr(p_name, 3, 6)), 'ACGTUacgtu', 'TGCAAtgcaa') AS seq FROM part WHERE regexp_matches(p_type, '(?i)^e|o$')")
def extracted(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("descriptor"), F.col("p_name").alias("seq"))
    return L.extracted(p, ["^E", "o$"], 2, 6, True).select("p_partkey", "seq")


@query("named_instance", "SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_brand, p_partkey) AS k FROM part) WHERE lower(p_name) = 'small widget' AND k = 2")
def named_instance(spark, d):
    f = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("s"), F.col("p_partkey").alias("e"))
    return L.named_instance(f, "SMALL widget", 2).select("p_partkey")


@query("chrom_names", "SELECT p_brand, CASE WHEN lower(p_brand) IN ('" + "', '".join(L.MITOCHONDRIAL) + "') THEN 'chrm' ELSE lower(p_brand) END AS name FROM (SELECT DISTINCT p_brand FROM part UNION SELECT 'MT' UNION SELECT 'chrM')")
def chrom_names(spark, d):
    b = table(spark, d, "part").select("p_brand").union(spark.createDataFrame([("MT",), ("chrM",)], "p_brand string")).distinct()
    return b.select("p_brand", L.chrom_name(F.col("p_brand")).alias("name"))


@query("first_on_chrom", with_("loci") + " SELECT chrom, s, e FROM loci QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY s, e) = 1")
def first_on_chrom(spark, d):
    return L.first_on_chrom(loci(spark, d))


@query("identity_bands", _elements + " SELECT CASE WHEN p >= 95 THEN 3 WHEN p >= 85 THEN 2 WHEN p >= 60 THEN 1 ELSE 0 END AS band, count(*) AS n FROM (SELECT 100.0 * matches / nullif(matches + mismatches, 0) AS p FROM el) GROUP BY 1")
def identity_bands(spark, d):
    return L.identity_bands(elements(spark, d), "matches", [60, 85, 95])


_blocks = "bl AS (SELECT chrom, k * 40 AS s, k * 40 + 29 AS e, (chrom + 1) % 7 AS to_chrom, 1000 + k * 35 AS to_s, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand FROM (SELECT DISTINCT chrom FROM loci), range(70) r(k))"
_parts = "p AS (SELECT src, to_chrom, bl.strand, CASE WHEN bl.strand = '-' THEN to_s + bl.e - least(l.e, bl.e) ELSE to_s + greatest(l.s, bl.s) - bl.s END AS to_s, least(l.e, bl.e) - greatest(l.s, bl.s) AS len FROM loci l JOIN bl ON l.chrom = bl.chrom AND l.s <= bl.e AND l.e >= bl.s)"


def blocks(spark, d):
    k = F.col("k")
    b = loci(spark, d).select("chrom").distinct().select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(69).cast("bigint"))).alias("k"))
    return b.select("chrom", (k * 40).alias("s"), (k * 40 + 29).alias("e"), ((F.col("chrom") + 1) % 7).alias("to_chrom"), (k * 35 + 1000).alias("to_s"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))


@query("remapped", with_("loci") + f", {_blocks}, {_parts} SELECT src, to_chrom, to_s, to_s + len AS to_e, strand FROM p")
def remapped(spark, d):
    return M.remapped(loci(spark, d), blocks(spark, d))


@query("remapped_ends", with_("loci") + f", {_blocks}, {_parts} SELECT src, to_chrom, min(to_s) AS to_s, max(to_s + len) AS to_e, CAST(sum(len + 1) AS BIGINT) AS bases FROM p GROUP BY src, to_chrom")
def remapped_ends(spark, d):
    return M.remapped_ends(loci(spark, d), blocks(spark, d))


def chrom_seqs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chrom"), F.col("text").alias("seq"))


@query("loci_slices", with_("loci") + " SELECT src, md5(CASE WHEN strand = '-' THEN translate(reverse(substr(text, CAST(greatest(s - 2, 0) + 1 AS BIGINT), CAST(e + 4 - greatest(s - 2, 0) AS BIGINT))), 'ACGTUacgtu', 'TGCAAtgcaa') ELSE substr(text, CAST(greatest(s - 3, 0) + 1 AS BIGINT), CAST(e + 3 - greatest(s - 3, 0) AS BIGINT)) END) AS seq FROM loci JOIN (SELECT doc_id, text FROM documents WHERE strlen(text) = length(text)) ON doc_id = chrom")
def loci_slices(spark, d):
    ascii_ = chrom_seqs(spark, d).filter("octet_length(seq) = char_length(seq)")
    return M.slices(loci(spark, d), ascii_, 3, 2).select("src", F.md5("seq").alias("seq"))


_sites = "si AS (SELECT chrom, s AS at_, min(flag) AS base FROM loci GROUP BY ALL)"


@query("with_sites", with_("loci") + f", {_sites}, c AS (SELECT doc_id AS chrom, i - 1 AS p, list_extract(a, i) AS c FROM (SELECT doc_id, string_split(text, '') AS a, unnest(range(1, len(string_split(text, '')) + 1)) AS i FROM documents WHERE length(text) > 0)) SELECT c.chrom, CAST(p // 1000 * 1000 AS BIGINT) AS s, md5(string_agg(coalesce(base, c), '' ORDER BY p)) AS seq FROM c LEFT JOIN si ON si.chrom = c.chrom AND si.at_ = p GROUP BY c.chrom, p // 1000")
def with_sites(spark, d):
    sites = loci(spark, d).select("chrom", F.col("s").alias("at"), F.col("flag").alias("base"))
    return M.with_sites(chrom_seqs(spark, d), sites).select("chrom", "s", F.md5("seq").alias("seq"))


@query("masked_bases", with_("loci") + ", c AS (SELECT doc_id AS chrom, i - 1 AS p, list_extract(a, i) AS c FROM (SELECT doc_id, string_split(text, '') AS a, unnest(range(1, len(string_split(text, '')) + 1)) AS i FROM documents WHERE length(text) > 0)), k AS (SELECT DISTINCT chrom, unnest(range(s, e + 1)) AS p FROM loci WHERE part % 40 = 3) SELECT c.chrom, CAST(c.p // 1000 * 1000 AS BIGINT) AS s, md5(string_agg(CASE WHEN k.p IS NULL THEN 'N' ELSE c END, '' ORDER BY c.p)) AS seq FROM c LEFT JOIN k ON k.chrom = c.chrom AND k.p = c.p GROUP BY c.chrom, c.p // 1000")
def masked_bases(spark, d):
    return M.masked(chrom_seqs(spark, d), loci(spark, d).filter("part % 40 = 3")).select("chrom", "s", F.md5("seq").alias("seq"))


@query("base_scores", with_("loci") + ", t AS (SELECT src AS read, chrom, s, e FROM loci QUALIFY count(*) OVER (PARTITION BY src) = 1), a AS (SELECT read, chrom, s + read % 5 - 2 AS s, e + read % 3 AS e FROM t WHERE read % 10 <> 0), x AS (SELECT t.read, CASE WHEN a.s IS NULL THEN 0 ELSE greatest(least(t.e, a.e) - greatest(t.s, a.s) + 1, 0) END AS b, coalesce(a.e - a.s + 1, 0) AS z, t.e - t.s + 1 AS w FROM t LEFT JOIN a USING (read)), y AS (SELECT count(*) AS reads, CAST(sum(b) AS BIGINT) AS tp, CAST(sum(z - b) AS BIGINT) AS fp, CAST(sum(w - b) AS BIGINT) AS fn FROM x) SELECT reads, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f FROM y")
def base_scores(spark, d):
    from pyspark.sql.window import Window

    t = loci(spark, d).select(F.col("src").alias("read"), "chrom", "s", "e").withColumn("k", F.count("*").over(Window.partitionBy("read"))).filter("k = 1").drop("k")
    a = t.filter("read % 10 <> 0").select("read", "chrom", (F.col("s") + F.col("read") % 5 - 2).alias("s"), (F.col("e") + F.col("read") % 3).alias("e"))
    return M.base_scores(a, t).select("reads", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query("local_peaks", with_("loci") + ", c AS (SELECT chrom, s, count(*) AS n FROM loci GROUP BY ALL), w AS (SELECT *, max(n) OVER (PARTITION BY chrom ORDER BY s RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS t, max(n) OVER (PARTITION BY chrom ORDER BY s RANGE BETWEEN 15 PRECEDING AND 1 PRECEDING) AS b FROM c) SELECT chrom, s, n FROM w WHERE n >= 2 AND n = t AND (b IS NULL OR b < n)")
def local_peaks(spark, d):
    c = loci(spark, d).groupBy("chrom", "s").agg(F.count("*").alias("n"))
    return M.local_peaks(c, ["chrom"], "s", "n", 15, 2)


@query("scaled_profile", with_("loci", "features", "genes") + " SELECT name, CAST((CASE WHEN g.strand = '-' THEN g.e - l.s ELSE l.s - g.s END) * 10 // (g.e - g.s + 1) AS BIGINT) AS bin, count(*) AS n FROM loci l JOIN genes g ON l.chrom = g.chrom AND l.s BETWEEN g.s AND g.e GROUP BY 1, 2")
def scaled_profile(spark, d):
    return M.scaled_profile(loci(spark, d), genes(spark, d), 10)


@query("window_density", with_("loci") + ", k AS (SELECT DISTINCT chrom, unnest(range(s, e + 1)) AS p FROM loci), b AS (SELECT chrom, p // 100 AS win, count(*) AS bases FROM k GROUP BY ALL), n AS (SELECT chrom, s // 100 AS win, count(*) AS n FROM loci GROUP BY ALL) SELECT chrom, win, coalesce(n, 0) AS n, bases FROM b LEFT JOIN n USING (chrom, win)")
def window_density(spark, d):
    return M.window_density(loci(spark, d), 100)


@query("hit_density", with_("loci") + ", b AS (SELECT chrom, s // 50 AS bin, count(*) AS n FROM loci GROUP BY ALL), m AS (SELECT chrom, max(bin) + 1 AS bins FROM b GROUP BY chrom), f AS (SELECT m.chrom, bins, coalesce(n, 0) AS n FROM m, LATERAL (SELECT unnest(range(bins)) AS bin) x LEFT JOIN b ON b.chrom = m.chrom AND b.bin = x.bin) SELECT chrom, any_value(bins) AS bins, round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS deviation, round(CASE WHEN avg(n) > 0 THEN 100 * coalesce(stddev_samp(n), 0) / avg(n) ELSE 100 END, 6) AS cov FROM f GROUP BY chrom")
def hit_density(spark, d):
    h = M.hit_density(loci(spark, d).select("chrom", F.col("s").alias("at")), 50)
    return h.select("chrom", "bins", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "cov")])


_rows = "al AS (SELECT p_partkey % 997 AS block, translate(p_name, 'aio', '---') AS seq FROM part WHERE length(p_name) = 10 UNION ALL SELECT p_partkey % 997, translate(p_name, 'e', '-') FROM part WHERE length(p_name) = 10), c AS (SELECT block, i - 1 AS p, upper(substr(seq, i, 1)) AS b FROM (SELECT block, seq, unnest(range(1, 11)) AS i FROM al)), per AS (SELECT block, p, max((b = '-')::INT) AS gap, (min(b) <> max(b))::INT AS bad FROM c GROUP BY ALL)"


def aligned(spark, d):
    p = table(spark, d, "part").filter("length(p_name) = 10")
    return p.select((F.col("p_partkey") % 997).alias("block"), F.translate("p_name", "aio", "---").alias("seq")).union(p.select(F.col("p_partkey") % 997, F.translate("p_name", "e", "-")))


@query("column_identity", f"WITH {_rows} SELECT block, count(*) AS columns, count(*) FILTER (WHERE gap = 0) AS aligned, count(*) FILTER (WHERE gap = 0 AND bad = 0) AS identical FROM per GROUP BY block")
def column_identity(spark, d):
    return M.column_identity(aligned(spark, d))


@query("gapless_parts", f"WITH {_rows}, g AS (SELECT *, p - row_number() OVER (PARTITION BY block ORDER BY p) AS run FROM per WHERE gap = 0) SELECT block, min(p) AS s, max(p) AS e FROM g GROUP BY block, run HAVING count(*) >= 2")
def gapless_parts(spark, d):
    return M.gapless_parts(aligned(spark, d), 2)


@query("conserved_runs", f"WITH {_rows}, g AS (SELECT *, p - row_number() OVER (PARTITION BY block ORDER BY p) AS run FROM per WHERE gap = 0), q AS (SELECT x.block, x.run, x.p AS s, max(y.p) AS e FROM g x JOIN g y ON x.block = y.block AND x.run = y.run AND y.p >= x.p AND y.bad = 0 AND (SELECT sum(z.bad) FROM g z WHERE z.block = x.block AND z.run = x.run AND z.p BETWEEN x.p AND y.p) <= 1 WHERE x.bad = 0 GROUP BY ALL) SELECT block, min(s) AS s, e FROM q GROUP BY block, run, e HAVING e - min(s) + 1 >= 1")
def conserved_runs(spark, d):
    return M.conserved_runs(aligned(spark, d), 1, 1)


@query("kmer_values", "WITH turns AS (SELECT conv_id * 1000 + turn AS id, text AS seq FROM conversations), w AS (SELECT id, i AS p, substr(seq, i + 1, 2) AS kmer FROM (SELECT id, seq, unnest(range(0, length(seq) - 1)) AS i FROM turns)), v AS (SELECT substr(p_name, 1, 2) AS kmer, min(p_retailprice) AS value FROM part GROUP BY 1) SELECT id, p AS at, coalesce(value, -1) AS value FROM w LEFT JOIN v USING (kmer)")
def kmer_values(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("seq"))
    v = table(spark, d, "part").groupBy(F.left("p_name", F.lit(2)).alias("kmer")).agg(F.min("p_retailprice").alias("value"))
    return M.lookup_along(S.kmer_index(turns, 2), v, -1.0).select("id", "at", "value")


@query("site_preference", "WITH o AS (SELECT substr(text, 1, 2) AS kmer, count(*) AS o FROM conversations WHERE length(text) >= 2 GROUP BY 1), b AS (SELECT substr(text, CAST(i AS BIGINT), 2) AS kmer, count(*) AS b FROM (SELECT text, unnest(range(1, length(text))) AS i FROM conversations) GROUP BY 1), x AS (SELECT kmer, coalesce(o, 0) AS o, b * ((SELECT sum(o) FROM o) / (SELECT sum(b) FROM b)) AS e FROM b LEFT JOIN o USING (kmer)) SELECT kmer, o AS observed, round(e, 6) AS expected, round(o / e, 6) AS ratio FROM x")
def site_preference(spark, d):
    t = table(spark, d, "conversations").filter("length(text) >= 2").select(F.col("turn").alias("id"), F.col("text").alias("seq"))
    starts = t.groupBy(F.left("seq", F.lit(2)).alias("kmer")).agg(F.count("*").alias("n"))
    p = M.site_preference(starts, S.kmer_index(t, 2).groupBy("kmer").agg(F.count("*").alias("n")))
    return p.select("kmer", "observed", F.round("expected", 6).alias("expected"), F.round("ratio", 6).alias("ratio"))


_bin = "CASE " + " ".join(f"WHEN s >> {b} = e >> {b} THEN {((1 << (29 - b)) - 1) // 7} + (s >> {b})" for b in (14, 17, 20, 23, 26)) + " ELSE 0 END"


@query("range_bins", with_("loci") + f", x AS (SELECT src, s * 20000 AS s, e * 20000 AS e FROM loci) SELECT src, {_bin} AS bin, CAST(1 + " + " + ".join(f"(e >> {b}) - (s >> {b}) + 1" for b in (14, 17, 20, 23, 26)) + " AS INTEGER) AS n FROM x")
def range_bins(spark, d):
    x = loci(spark, d).select("src", (F.col("s") * 20000).alias("s"), (F.col("e") * 20000).alias("e"))
    return x.select("src", T.range_bin(F.col("s"), F.col("e")).alias("bin"), F.size(T.overlapping_bins(F.col("s"), F.col("e"))).alias("n"))
