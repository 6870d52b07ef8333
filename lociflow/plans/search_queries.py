"""Queries of search, reads, graphs of overlaps, simulation and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as Q
from ..operators import assembly as A, reads as R, search as S, series as P, simulate as M
from ..sources.adapters import loci, series, terms, with_
from ..sources.storage import table

QUERIES, ORACLES = {}, {}


def query(name, oracle):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))


def turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("seq"))


def probes(spark, d, size=16):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.left("text", F.lit(size)).alias("seq"))


def names(spark, d):
    """Each name of a part once, by its smallest key."""
    return table(spark, d, "part").groupBy(F.col("p_name").alias("seq")).agg(F.min("p_partkey").alias("id")).select("id", "seq")


_turns = "turns AS (SELECT conv_id * 1000 + turn AS id, text AS seq FROM conversations), probes AS (SELECT item_id AS id, substr(text, 1, 9) AS seq FROM benchmark)"
_names = "names AS (SELECT min(p_partkey) AS id, p_name AS seq FROM part GROUP BY p_name)"


@query("contaminant_hits", "SELECT doc_id AS id, item_id AS probe FROM documents d, benchmark b WHERE length(b.text) >= 24 AND contains(d.text, b.text)")
def contaminant_hits(spark, d):
    return S.contained(texts(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("seq")), 24)


_exact = "probes AS (SELECT item_id AS id, substr(text, 1, 16) AS seq FROM benchmark), c AS (SELECT p.id, p.seq AS probe, doc_id AS target, text FROM documents, probes p WHERE length(p.seq) = 16 AND contains(text, p.seq)), h AS (SELECT id, target, i AS at_ FROM (SELECT id, target, probe, text, unnest(range(0, length(text) - 15)) AS i FROM c) WHERE substr(text, i + 1, 16) = probe)"


@query("exact_hits", f"WITH {_exact} SELECT id, target, at_ AS at FROM h")
def exact_hits(spark, d):
    return S.exact_hits(probes(spark, d), texts(spark, d), 16)


@query("hit_counts", f"WITH {_exact}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY target, at_) AS a, row_number() OVER (PARTITION BY id ORDER BY target DESC, at_ DESC) AS z FROM h) SELECT id, count(*) AS n, max(target) FILTER (WHERE a = 1) AS first_target, max(at_) FILTER (WHERE a = 1) AS first_at, max(target) FILTER (WHERE z = 1) AS last_target, max(at_) FILTER (WHERE z = 1) AS last_at FROM r GROUP BY id")
def hit_counts(spark, d):
    return S.hit_counts(S.exact_hits(probes(spark, d), texts(spark, d), 16))


def subs_sql(a: str, b: str, n: str) -> str:
    """Places in which two texts of n characters differ; DuckDB's own function counts bytes."""
    return f"CASE WHEN strlen({a}) = {n} AND strlen({b}) = {n} THEN hamming({a}, {b}) ELSE list_sum(list_transform(range(1, {n} + 1), lambda i: (substr({a}, i, 1) <> substr({b}, i, 1))::INT)) END"


_near = f"WITH {_turns}, w AS (SELECT id AS target, i AS at_, substr(seq, i + 1, 9) AS win FROM (SELECT id, seq, unnest(range(0, length(seq) - 8)) AS i FROM turns)), h AS (SELECT * FROM (SELECT p.id, target, at_, {subs_sql('win', 'p.seq', '9')} AS subs FROM w, probes p WHERE length(p.seq) = 9) WHERE subs <= 2)"


def _found(spark, d):
    return S.near_hits(probes(spark, d, 9), turns(spark, d), 9, 2)


@query("near_hits", _near + " SELECT id, target, at_ AS at, CAST(subs AS INTEGER) AS subs FROM h")
def near_hits(spark, d):
    return _found(spark, d)


@query("best_hits", _near + " SELECT id, target, at_ AS at, CAST(subs AS INTEGER) AS subs, rank, count(*) FILTER (WHERE subs = least) OVER (PARTITION BY id) AS as_good FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY subs, target, at_) AS rank, min(subs) OVER (PARTITION BY id) AS least FROM h) QUALIFY rank <= 3")
def best_hits(spark, d):
    return S.best_hits(_found(spark, d), 3).withColumn("rank", F.col("rank").cast("bigint"))


@query("unique_hits", _near + ", r AS (SELECT *, min(subs) OVER (PARTITION BY id) AS least FROM h) SELECT id, any_value(target) AS target, any_value(at_) AS at, CAST(any_value(subs) AS INTEGER) AS subs FROM r WHERE subs = least GROUP BY id HAVING count(*) = 1")
def unique_hits(spark, d):
    return S.unique_hits(_found(spark, d))


@query("both_strands", f"WITH {_names} SELECT id, '+' AS strand, seq FROM names UNION ALL SELECT id, '-', translate(reverse(seq), 'ACGTUacgtu', 'TGCAAtgcaa') FROM names")
def both_strands(spark, d):
    return S.both_strands(names(spark, d))


ADAPTERS = ["tion the", "esn. Th", "and ther"]
_fit = "coalesce(list_max(list_filter(range(2, least(length(seq), length('{0}')) + 1), lambda n: list_sum(list_transform(range(1, n + 1), lambda i: (substr(right(seq, n), i, 1) <> substr('{0}', i, 1))::INT)) <= floor(n * 0.34))), 0)"


@query("adapter_overlaps", f"WITH {_turns} SELECT id, CAST(greatest(" + ", ".join(_fit.format(a) for a in ADAPTERS) + ") AS INTEGER) AS overlap FROM turns")
def adapter_overlaps(spark, d):
    return S.adapter_overlaps(turns(spark, d), ADAPTERS, 2, 0.34).select("id", F.col("overlap").cast("int").alias("overlap"))


@query("column_consensus", "WITH c AS (SELECT role AS grp, i - 1 AS at_, substr(text, i, 1) AS base, count(*) AS n FROM (SELECT role, text, unnest(range(1, length(text) + 1)) AS i FROM conversations) GROUP BY ALL) SELECT grp, at_ AS at, base, n FROM c QUALIFY row_number() OVER (PARTITION BY grp, at_ ORDER BY n DESC, base) = 1")
def column_consensus(spark, d):
    each = table(spark, d, "conversations").select(F.col("role").alias("grp"), F.posexplode(R.characters(F.col("text"))).alias("at", "base"))
    return S.column_consensus(each.withColumn("at", F.col("at").cast("bigint")))


@query("end_overlaps", f"WITH {_names} SELECT x.id AS a, y.id AS b, n AS size FROM names x, names y, range(2, 13) r(n) WHERE x.id <> y.id AND n <= length(x.seq) AND n <= length(y.seq) AND right(x.seq, n) = left(y.seq, n)")
def end_overlaps(spark, d):
    return S.end_overlaps(names(spark, d), 2)


_words = "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS seq FROM part UNION SELECT DISTINCT p_name FROM part), x AS (SELECT row_number() OVER (ORDER BY seq) AS id, seq FROM w)"


@query("without_contained", f"WITH {_words} SELECT seq FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.seq <> x.seq AND contains(y.seq, x.seq))")
def without_contained(spark, d):
    from pyspark.sql.window import Window

    p = table(spark, d, "part")
    w = p.select(F.explode(F.split("p_name", " ")).alias("seq")).union(p.select("p_name")).distinct()
    return S.without_contained(w.withColumn("id", F.xxhash64("seq")), 3).select("seq")


@query("reciprocal", "WITH h AS (SELECT DISTINCT l_partkey % 97 AS a, l_orderkey % 89 AS b FROM lineitem) SELECT x.a, x.b FROM h x JOIN h y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def reciprocal(spark, d):
    return S.reciprocal(table(spark, d, "lineitem").select((F.col("l_partkey") % 97).alias("a"), (F.col("l_orderkey") % 89).alias("b")))


_wins = f"{_names}, w AS (SELECT id, i AS at_, substr(seq, i + 1, 6) AS win FROM (SELECT id, seq, unnest(range(0, length(seq) - 5)) AS i FROM names))"


@query("least_substitutions", f"WITH {_wins}, d AS (SELECT win, count(*) AS n FROM w GROUP BY win), m AS (SELECT x.win, CASE WHEN any_value(x.n) > 1 THEN 0 ELSE min(hamming(x.win, y.win)) END AS least FROM d x LEFT JOIN d y ON x.win <> y.win AND hamming(x.win, y.win) <= 2 GROUP BY x.win) SELECT id, at_ AS at, CAST(least AS INTEGER) AS least FROM w JOIN m USING (win)")
def least_substitutions(spark, d):
    return S.least_substitutions(names(spark, d), 6, 2).withColumn("least", F.col("least").cast("int"))


@query("least_substitutions_reverse", f"WITH {_wins}, d AS (SELECT DISTINCT win FROM w), m AS (SELECT x.win, min(hamming(translate(reverse(x.win), 'ACGTUacgtu', 'TGCAAtgcaa'), y.win)) AS least FROM d x LEFT JOIN d y ON hamming(translate(reverse(x.win), 'ACGTUacgtu', 'TGCAAtgcaa'), y.win) <= 3 GROUP BY x.win) SELECT id, at_ AS at, CAST(least AS INTEGER) AS least FROM w JOIN m USING (win)")
def least_substitutions_reverse(spark, d):
    return S.least_substitutions(names(spark, d), 6, 3, reverse=True).withColumn("least", F.col("least").cast("int"))


@query("merged_distances", "SELECT id, at_ AS at, min(least) AS least FROM (SELECT l_orderkey AS id, l_linenumber AS at_, l_quantity AS least FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_tax * 100 FROM lineitem) GROUP BY ALL")
def merged_distances(spark, d):
    l = table(spark, d, "lineitem")
    of = lambda v: l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("at"), v.alias("least"))
    return S.merged_distances(of(F.col("l_quantity")), of(F.col("l_tax") * 100))


@query("site_flanks", "WITH s AS (SELECT doc_id, unnest([3, 40, 200]) AS a FROM documents) SELECT d.doc_id AS site, CAST(a AS BIGINT) AS at, md5(CASE WHEN a >= 8 AND a + 8 < length(text) AND NOT contains(upper(substr(text, a - 7, 17)), 'N') THEN substr(text, a - 7, 17) END) AS flank FROM s JOIN documents d USING (doc_id)")
def site_flanks(spark, d):
    t = texts(spark, d)
    sites = t.select(F.col("id").alias("site"), "id", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (3, 40, 200)])).alias("at"))
    return S.flanks(sites, t, 8, 8).select("site", "at", F.md5("flank").alias("flank"))


@query("kmers_by_offset", f"WITH {_turns}, w AS (SELECT i AS at_, substr(seq, i + 1, 3) AS kmer FROM (SELECT seq, unnest(range(0, length(seq) - 2)) AS i FROM turns)) SELECT at_ AS at, kmer, count(*) AS n FROM w GROUP BY ALL")
def kmers_by_offset(spark, d):
    return R.kmers_by_offset(S.kmer_index(turns(spark, d), 3))


@query("quality_filtered", f"WITH {_turns}, q AS (SELECT id, any_value(seq) AS seq, avg(least(greatest(unicode(c) - 33, 0), 41)) AS m FROM (SELECT id, seq, unnest(string_split(seq, '')) AS c FROM turns WHERE length(seq) > 0) GROUP BY id) SELECT id FROM q WHERE m >= 33.5 AND NOT contains(upper(seq), 'Y')")
def quality_filtered(spark, d):
    reads = turns(spark, d).filter("length(seq) > 0").withColumn("qual", F.col("seq"))
    return R.quality_filtered(reads, 0, 33.5, "Y").select("id")


@query("unknown_by_offset", f"WITH {_turns} SELECT i - 1 AS at, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM turns) WHERE upper(substr(seq, i, 1)) = 'E' GROUP BY i")
def unknown_by_offset(spark, d):
    return R.unknown_by_offset(turns(spark, d), "E")


@query("pair_duplicates", "SELECT min(p_partkey) AS id, count(*) AS copies FROM part GROUP BY least(p_name, p_type), greatest(p_name, p_type)")
def pair_duplicates(spark, d):
    return R.pair_duplicates(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("seq1"), F.col("p_type").alias("seq2")))


@query("stacks", "SELECT p_name AS seq, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def stacks(spark, d):
    return R.stacks(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("seq")))


@query("split_pairs", "SELECT p_partkey AS id, 1 AS mate, left(p_name, CAST(ceil(length(p_name) / 2) AS INTEGER)) AS seq FROM part UNION ALL SELECT p_partkey, 2, translate(reverse(substr(p_name, CAST(ceil(length(p_name) / 2) AS INTEGER) + 1)), 'ACGTUacgtu', 'TGCAAtgcaa') FROM part")
def split_pairs(spark, d):
    return R.split_pairs(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("seq")), True)


@query("band_match", with_("series") + " SELECT a.event_id, b.event_id AS r_event_id, b.pos - a.pos AS distance FROM series a JOIN series b ON a.chrom = b.chrom AND abs(a.pos - b.pos) <= 1800 WHERE a.event_type = 'click' AND b.event_type <> 'click'")
def band_match(spark, d):
    s = series(spark, d).select("chrom", "pos", "event_id", "event_type")
    return P.band_pairs(s.filter("event_type = 'click'"), s.filter("event_type <> 'click'"), ["chrom"], "pos", 1800).select("event_id", "r_event_id", "distance")


_edges = "e AS (SELECT child AS a, parent AS b, child % 7 + 1 AS size FROM terms)"


def term_edges(spark, d):
    return terms(spark, d).select(F.col("child").alias("a"), F.col("parent").alias("b"), (F.col("child") % 7 + 1).alias("size"))


@query("best_edges", "SELECT l_partkey % 100 AS a, l_suppkey % 90 AS b, max(l_quantity) AS size FROM lineitem WHERE l_partkey % 100 <> l_suppkey % 90 GROUP BY 1, 2")
def best_edges(spark, d):
    return A.best_edges(table(spark, d, "lineitem").select((F.col("l_partkey") % 100).alias("a"), (F.col("l_suppkey") % 90).alias("b"), F.col("l_quantity").alias("size")))


@query("reduced_edges", with_("terms", then=_edges) + " SELECT a, b, size FROM e WHERE NOT EXISTS (SELECT 1 FROM e x JOIN e y ON x.b = y.a WHERE x.a = e.a AND y.b = e.b)")
def reduced_edges(spark, d):
    return A.reduced_edges(term_edges(spark, d))


@query("highest_paths", "WITH RECURSIVE " + with_("terms", then=_edges).removeprefix("WITH ") + ", r AS (SELECT a AS node, CAST(0 AS BIGINT) AS score FROM e UNION SELECT b, 0 FROM e UNION SELECT e.b, r.score + e.size FROM r JOIN e ON r.node = e.a) SELECT node, max(score) AS score FROM r GROUP BY node")
def highest_paths(spark, d):
    return A.highest_paths(term_edges(spark, d)).select("node", "score")


_links = "p AS (SELECT part % 400 AS contig1, chrom AS contig2, qty AS gap FROM loci), k AS (SELECT least(contig1, contig2) AS a, greatest(contig1, contig2) AS b, count(*) AS n, avg(gap) AS gap FROM p WHERE contig1 <> contig2 GROUP BY 1, 2 HAVING count(*) >= 4)"


def links(spark, d):
    return A.scaffold_edges(loci(spark, d).select((F.col("part") % 400).alias("contig1"), F.col("chrom").alias("contig2"), F.col("qty").alias("gap")), 4)


@query("scaffold_edges", with_("loci", then=_links) + " SELECT a, b, n, round(gap, 6) AS gap FROM k")
def scaffold_edges(spark, d):
    return links(spark, d).withColumn("gap", F.round("gap", 6))


_uniform = "(CAST('0x' || left(md5({}), 13) AS BIGINT) / 4503599627370496.0)"


def u_sql(*of: str) -> str:
    return _uniform.format("concat_ws('|', " + ", ".join(of) + ")")


@query("simulated_genome", f"WITH p AS (SELECT c, a, substr('ACGT', CAST(floor({u_sql('7', 'c', 'a')} * 4) AS INTEGER) + 1, 1) AS base FROM range(3) x(c), range(2500) y(a)) SELECT c AS chrom, CAST(a // 1000 * 1000 AS BIGINT) AS start, md5(string_agg(base, '' ORDER BY a)) AS seq FROM p GROUP BY c, a // 1000")
def simulated_genome(spark, d):
    return M.genome(spark, 3, 2500, 7).select("chrom", "start", F.md5("seq").alias("seq"))


_place = f"r AS (SELECT i, CAST(floor({u_sql('5', '1', 'i')} * 3) AS BIGINT) AS chrom, CAST(floor({u_sql('5', '2', 'i')} * 2451) AS BIGINT) AS start, CASE WHEN {u_sql('5', '3', 'i')} < 0.5 THEN '+' ELSE '-' END AS strand FROM range(300) x(i))"


@query(
    "simulated_reads",
    f"""WITH {_place}, b AS (SELECT *, floor({u_sql('7', 'chrom', 'start + k')} * 4) AS base, CASE WHEN {u_sql('5', '4', 'i', 'k')} < 0.05 THEN 1 + floor({u_sql('5', '5', 'i', 'k')} * 3) ELSE 0 END AS move FROM r, range(50) y(k)),
    s AS (SELECT i, chrom, start, strand, string_agg(substr('ACGT', CAST((base + move) % 4 AS INTEGER) + 1, 1), '' ORDER BY k) AS seq, count(*) FILTER (WHERE move > 0) AS subs FROM b GROUP BY ALL)
    SELECT i AS id, chrom, start, strand, CASE WHEN strand = '-' THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END AS seq, CAST(subs AS INTEGER) AS subs FROM s""",
)
def simulated_reads(spark, d):
    return M.reads(spark, 300, 3, 2500, 50, 0.05, 7, 5)


@query("resampled", f"WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY {u_sql('3', 's_suppkey')}, s_suppkey) AS n FROM supplier), t AS (SELECT count(*) AS t FROM supplier), x AS (SELECT id // t AS round, CAST(floor({u_sql('3', 'id')} * t) AS BIGINT) + 1 AS n FROM t, range(1000000) r(id) WHERE id < 4 * t) SELECT round, s_suppkey FROM x JOIN s USING (n)")
def resampled(spark, d):
    return M.resampled(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], 4, 3).select("round", "s_suppkey")


@query("limited", f"SELECT p_partkey FROM part ORDER BY {u_sql('9', 'p_partkey')}, p_partkey LIMIT 50")
def limited(spark, d):
    """50 random parts: the limit is the feature."""
    return M.limited(table(spark, d, "part").select("p_partkey"), ["p_partkey"], 50, 9)


_profile = "c AS (SELECT qty, count(*) AS n FROM loci GROUP BY qty), u AS (SELECT qty, n, sum(n) OVER (ORDER BY n DESC, qty) AS u, sum(n) OVER () AS t FROM c)"


@query("observed_profile", with_("loci", then=_profile) + " SELECT qty, n, round((u - n) / t, 9) AS low, round(u / t, 9) AS high FROM u")
def observed_profile(spark, d):
    p = M.profile(loci(spark, d), "qty")
    return p.select("qty", "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("drawn_from_profile", with_("loci", then=_profile) + f", r AS (SELECT i, {u_sql('4', 'i')} AS x FROM range(500) y(i)) SELECT i AS id, qty FROM r JOIN u ON x >= (u - n) / t AND x < u / t")
def drawn_from_profile(spark, d):
    return M.drawn(spark, 500, M.profile(loci(spark, d), "qty"), "qty", 4)


@query("octamers", "SELECT string_agg(substr('ACGT', CAST((i >> (2 * (7 - k))) & 3 AS INTEGER) + 1, 1), '' ORDER BY k) AS seq FROM range(65536) x(i), range(8) y(k) GROUP BY i")
def octamers(spark, d):
    return M.octamers(spark)


@query("log_factorials", "SELECT CAST(i AS BIGINT) AS n, round(lgamma(i + 1), 6) AS log FROM range(0, 3000, 7) r(i)")
def log_factorials(spark, d):
    return spark.range(0, 3000, 7).select(F.col("id").alias("n"), F.round(M.log_factorial(F.col("id")), 6).alias("log"))


@query("base_letters", "SELECT doc_id, md5(translate(regexp_replace(regexp_replace(text, '[^ACGTUacgtua-z-]', 'N', 'g'), '[bd-fh-sv-z]', 'n', 'g'), 'Uu', 'Tt')) AS letters FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F]*', 's')")
def base_letters(spark, d):
    t = table(spark, d, "documents").filter(F.col("text").rlike(r"\A[\x00-\x7F]*\z"))
    return t.select("doc_id", F.md5(Q.letters(Q.base_codes(F.col("text")))).alias("letters"))


@query("packed_bases", "SELECT p_partkey, translate(regexp_replace(upper(p_name), '[^ACGTU-]', 'N', 'g'), 'U', 'T') AS seq FROM part")
def packed_bases(spark, d):
    """Names as bases, packed and unpacked again."""
    return table(spark, d, "part").select("p_partkey", Q.unpacked(Q.packed(F.upper("p_name"))).alias("seq"))


_hash = "list_reduce(list_prepend(CAST({seed} AS BIGINT), list_transform(string_split(lower({name}), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: xor(((xor(h, c) * {factor} + 2147483648) & 4294967295) - 2147483648, (((xor(h, c) * {factor} + 2147483648) & 4294967295) - 2147483648) >> {shift}) & {mask})"


@query("name_hashes", "SELECT p_partkey, " + ", ".join(f"CAST(CASE WHEN {_hash.format(seed=s, factor=f, shift=h, mask=(1 << b) - 1, name='p_brand')} = 0 THEN {z} ELSE {_hash.format(seed=s, factor=f, shift=h, mask=(1 << b) - 1, name='p_brand')} END AS INTEGER) AS h{b}" for b, (s, f, h, z) in Q.NAME_HASHES.items()) + " FROM part")
def name_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", *[Q.name_hash(F.col("p_brand"), b).alias(f"h{b}") for b in Q.NAME_HASHES])


@query("clean_texts", "SELECT doc_id, md5(regexp_replace(text, '[\\x00-\\x1f%''\"]', ' ', 'g')) AS clean FROM documents")
def clean_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(Q.clean_text(F.col("text"))).alias("clean"))


@query("path_parts", "SELECT page_id, regexp_extract(url, '^(.*/)?([^/]*)$', 1) AS dir, regexp_extract(url, '^(.*/)?([^/]*)$', 2) AS name FROM pages")
def path_parts(spark, d):
    return table(spark, d, "pages").select("page_id", Q.path_parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query("edit_distances", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance, CAST(CASE WHEN length(p_name) = length(p_type) THEN hamming(p_name, p_type) END AS INTEGER) AS subs FROM part")
def edit_distances(spark, d):
    return table(spark, d, "part").select("p_partkey", Q.edit_distance(F.col("p_name"), F.col("p_type")).alias("distance"), Q.substitutions(F.col("p_name"), F.col("p_type")).alias("subs"))


@query("name_lists", "SELECT p_partkey, len(list_distinct(list_filter(regexp_split_to_array(p_name || ', ' || p_type || ';' || p_name, '[,;\\s]+'), lambda x: x <> ''))) AS n FROM part")
def name_lists(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(Q.name_list(F.concat("p_name", F.lit(", "), "p_type", F.lit(";"), "p_name"))).cast("bigint").alias("n"))


_seeds = "names AS (SELECT min(p_partkey) AS id, p_name AS seq FROM part GROUP BY p_name), w AS (SELECT id, i AS p, substr(seq, i + 1, 3) AS kmer FROM (SELECT id, seq, unnest(range(0, length(seq) - 2)) AS i FROM names)), sd AS (SELECT a.id AS query, b.id AS target, a.p AS q_at, b.p AS t_at FROM w a JOIN w b USING (kmer))"


@query("seed_hits", f"WITH {_seeds} SELECT query, target, q_at, t_at FROM sd")
def seed_hits(spark, d):
    return S.seed_hits(names(spark, d), names(spark, d), 3)


@query("seed_nodes", f"WITH {_seeds}, r AS (SELECT DISTINCT *, t_at - q_at AS dg FROM sd), x AS (SELECT *, CASE WHEN q_at <= lag(q_at) OVER (PARTITION BY query, target, dg ORDER BY q_at) + 3 THEN 0 ELSE 1 END AS f FROM r), y AS (SELECT *, sum(f) OVER (PARTITION BY query, target, dg ORDER BY q_at) AS run FROM x) SELECT query, target, min(q_at) AS q_s, max(q_at) + 2 AS q_e, min(t_at) AS t_s, max(t_at) + 2 AS t_e FROM y GROUP BY query, target, dg, run")
def seed_nodes(spark, d):
    return S.seed_nodes(S.seed_hits(names(spark, d), names(spark, d), 3), 3)


@query("paired_hits", "WITH h AS (SELECT l_partkey % 50 AS id, l_suppkey AS target, l_orderkey % 1000 AS p FROM lineitem) SELECT a.id, a.target, a.p AS at, b.p AS mate_at, b.p - a.p AS insert FROM h a JOIN h b ON a.id = b.id AND a.target = b.target AND b.p - a.p BETWEEN 20 AND 60")
def paired_hits(spark, d):
    h = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("id"), F.col("l_suppkey").alias("target"), (F.col("l_orderkey") % 1000).alias("at"))
    return S.paired_hits(h, h, 20, 60)


@query("split_reads", "SELECT conv_id * 1000 + turn AS id, CAST(i - 1 AS INTEGER) AS part, a[i] AS seq FROM (SELECT conv_id, turn, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT conv_id, turn, regexp_split_to_array(text, '(?i)(?:the|eha)') AS a FROM conversations)) WHERE length(a[i]) >= 12")
def split_reads(spark, d):
    """Turns between the word `the`; the other strand of its letters stands in for an adapter's."""
    return S.split_reads(turns(spark, d), "the", 12).withColumn("part", F.col("part").cast("int"))
