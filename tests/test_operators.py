"""Operators against brute force, where SQL has no form for them or blocks and levels should be crossed."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociflow import catalog
from lociflow.functions import genes as G, sequence as Q
from lociflow.operators import assembly, expression, genes, haplotypes, intervals, ontology, reads, scans, search, series, simulate, tables


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture
def rng():
    return random.Random(5)


def test_running_over_narrow_blocks(spark, rng):
    data = [(rng.choice("ab"), p, rng.randint(-5, 9)) for p in rng.sample(range(500), 80)]
    df = spark.createDataFrame(data, "k string, p long, v long")
    got = rows(scans.running(df, ["k"], ["p"], "p", {"upto": ("sum", F.col("v")), "most": ("max", F.col("v"))}, before=True, width=7, next_position="next", totals=True), "k", "p", "upto", "most", "next", "all_upto")
    want = []
    for k, p, _ in data:
        before = [v for a, q, v in data if a == k and q < p]
        after = [q for a, q, _ in data if a == k and q > p]
        want.append((k, p, sum(before), max(before, default=None), min(after, default=None), sum(v for a, _, v in data if a == k)))
    assert got == sorted(want, key=repr)
    d = scans.following(df, ["k"], "p", {"np": "p", "nv": "v"}, width=5)
    assert rows(d, "k", "p", "np") == sorted([(k, p, n) for k, p, _, _, n, _ in want], key=repr)


@pytest.mark.parametrize("width", [3, 64, 1 << 20])
def test_islands_and_depth_by_brute_force(spark, rng, width):
    data = [(rng.choice("ab"), s, s + rng.choice([0, 1, 4, 30, 150])) for s in (rng.randint(0, 900) for _ in range(60))]
    df = spark.createDataFrame(data, "chrom string, s long, e long")
    cover = {c: Counter(p for k, s, e in data if k == c for p in range(s, e + 1)) for c in "ab"}
    for gap in (0, 5):
        want = []
        for c in "ab":
            for s, e in sorted((s, e) for k, s, e in data if k == c):
                if want and want[-1][0] == c and s <= want[-1][2] + 1 + gap:
                    want[-1] = (c, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
                else:
                    want.append((c, s, e, 1))
        assert rows(intervals.merge_islands(df, ["chrom"], gap, width=width), "chrom", "s", "e", "n") == sorted(want, key=repr)
    segments = rows(intervals.depth_segments(df, ["chrom"], {"n": F.lit(True)}, width=width), "chrom", "s", "e", "n")
    assert {(c, p): n for c, s, e, n in segments for p in range(s, e + 1)} == {(c, p): n for c in "ab" for p, n in cover[c].items()}


@pytest.mark.parametrize("flank", [0, 40])
def test_overlap_join_of_all_lengths(spark, rng, flank):
    def some(n):
        return [(i, rng.choice("ab"), s, s + rng.choice([0, 3, 63, 64, 65, 700, 5000, 90_000])) for i, s in enumerate(rng.randint(0, 100_000) for _ in range(n))]

    left, right = some(60), some(60)
    l, r = (spark.createDataFrame(x, "src long, chrom string, s long, e long") for x in (left, right))
    want = sorted(((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] <= b[3] + flank and a[3] >= b[2] - flank), key=repr)
    assert rows(intervals.overlap_join(l, r, flank), "src", "r_src") == want
    if not flank:
        hit = {a for a, _ in want}
        for width in (50, 4096):
            assert [x for x, in rows(intervals.overlap_any(l, r, width=width), "src")] == sorted(hit, key=repr)
            assert [x for x, in rows(intervals.overlap_any(l, r, anti=True, width=width), "src")] == sorted({a[0] for a in left} - hit, key=repr)


def test_kmers_cross_pieces(spark, rng):
    text = "".join(rng.choice("acgté😀") for _ in range(700))
    df = spark.createDataFrame([(1, text), (2, "ab"), (3, None), (4, "")], "id long, text string")
    for k in (1, 3, 200):
        want = Counter(text[i : i + k] for i in range(len(text) - k + 1)) + Counter("ab"[i : i + k] for i in range(max(0, 3 - k)))
        got = Counter(r["kmer"] for r in tables.kmers(df, k, []).collect())
        assert got == want
    index = rows(search.kmer_index(df.withColumnRenamed("text", "seq"), 5), "id", "at", "kmer")
    assert index == sorted([(1, i, text[i : i + 5]) for i in range(len(text) - 4)], key=repr)


def test_sub_sequences(spark):
    df = spark.createDataFrame([("abcdefghij",), ("",), (None,)], "s string")
    got = [None if r[0] is None else [tuple(x) for x in r[0]] for r in df.select(Q.sub_sequences(F.col("s"), 5, 2)).collect()]
    assert got[0] == [(i, "abcdefghij"[i : i + 5]) for i in range(0, 10, 2)]
    assert sorted(map(repr, got[1:])) == ["None", "[]"]


@pytest.mark.parametrize("size, width", [(5, 7), (11, 12), (40, 9), (7, 100)])
def test_window_mean(spark, rng, size, width):
    v = [rng.randint(0, 99) for _ in range(size)]
    out = series.window_mean(spark.createDataFrame([("k", i, x) for i, x in enumerate(v)], "k string, i long, v long"), ["k"], ["i"], "v", width, "m")
    w = min(max(width, series.NARROW), size)
    want = v if size < series.LEAST else [sum(part) // len(part) for part in (v[max(0, i - (w - w // 2)) : i + w // 2] for i in range(size))]
    assert [m for _, m in rows(out, F.format_string("%05d", "i"), "m")] == want


@pytest.mark.parametrize("method", ["bonferroni", "holm", "bh"])
def test_corrections_with_ties_and_tiny_values(spark, rng, method):
    p = [0.0, 0.0, 1e-300, 1e-300, 1e-12, 0.5, 0.5, 0.5, 1.0] + [rng.random() ** 9 for _ in range(60)]
    out = rows(tables.corrected(spark.createDataFrame(list(enumerate(p)), "id long, p double"), method), "id", "adj")
    order = sorted(range(len(p)), key=lambda i: (p[i], i))
    for rank, i in enumerate(order, 1):
        factor = {"bonferroni": len(p), "holm": len(p) - rank + 1, "bh": len(p) / rank}[method]
        assert dict(out)[i] == pytest.approx(min(1.0, p[i] * factor))


def align(a, b, match, mismatch, gap, local):
    best = (0, 0, 0)
    h = [[0 if local else -gap * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else -mismatch), h[i - 1][j] - gap, h[i][j - 1] - gap, *([0] if local else []))
            if local and h[i][j] > best[0]:
                best = (h[i][j], i, j)
    return best if local else (h[-1][-1], len(a), len(b))


def test_alignments(spark, rng):
    pairs = [("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 20))), "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 20)))) for _ in range(60)]
    df = spark.createDataFrame([*pairs, (None, "A")], "a string, b string")
    for local, f in ((True, search.local_alignment), (False, search.global_alignment)):
        got = [tuple(r[0]) if r[0] is not None else None for r in df.coalesce(1).select(f(F.col("a"), F.col("b"), 2, 1, 2)).collect()]
        assert got[:-1] == [align(a, b, 2, 1, 2, local) for a, b in pairs]


def test_hits_on_random_sequences(spark, rng):
    targets = [(i, "".join(rng.choice("ACGT") for _ in range(120))) for i in range(4)]
    probes = []
    for i in range(25):
        t = rng.choice(targets)[1]
        at = rng.randint(0, 108)
        p = list(t[at : at + 12])
        for k in rng.sample(range(12), rng.randint(0, 3)):
            p[k] = rng.choice("ACGT")
        probes.append((i, "".join(p)))
    t, p = (spark.createDataFrame(x, "id long, seq string") for x in (targets, probes))
    want = [(i, j, at, sum(x != y for x, y in zip(s, seq[at : at + 12], strict=True))) for i, s in probes for j, seq in targets for at in range(109)]
    hits = search.near_hits(p, t, 12, 2)
    assert rows(hits, "id", "target", "at", "subs") == sorted([w for w in want if w[3] <= 2], key=repr)
    assert rows(search.exact_hits(p, t, 6), "id", "target", "at") == sorted([w[:3] for w in want if w[3] == 0], key=repr)
    best = {i: min(w[3] for w in want if w[0] == i) for i, _ in probes}
    unique = [w for w in want if w[3] == best[w[0]] <= 2 and sum(x[0] == w[0] and x[3] == w[3] for x in want) == 1]
    assert rows(search.unique_hits(hits), "id", "target", "at", "subs") == sorted(unique, key=repr)


def test_tandem_repeats(spark):
    df = spark.createDataFrame([(1, "xxACACACACGGTTTTTTGATGATGATc"), (2, None), (3, "ATATAT")], "id long, seq string")
    assert rows(reads.tandem_repeats(df, 1, 3, 3, 10), "id", "at", "unit", "n") == [(1, 17, "TGA", 3), (1, 2, "AC", 4), (3, 0, "AT", 3)]
    assert rows(reads.tandem_repeats(df, 2, 2, 3, 3), "id", "unit") == [(3, "AT")]


def test_merged_pairs(spark):
    whole = "ACGTTGCAACGGTATC"
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    two = whole[6:]
    changed = "T" + two[1:]  # a low-quality base that differs
    data = [(1, whole[:11], "I" * 11, flip(two), "I" * 10), (2, whole[:11], "I" * 11, flip(changed), "I" * 9 + "#"), (3, "AAAAAA", "IIIIII", "GGGGGG", "IIIIII"), (4, None, None, "A", "I")]
    out = rows(reads.merged_pairs(spark.createDataFrame(data, "id long, seq1 string, qual1 string, seq2 string, qual2 string"), 4, 0.25), "id", "size", "seq")
    assert out == [(1, 5, whole), (2, 5, whole), (3, 0, None), (4, 0, None)]


def test_statistics(spark):
    tables_ = [(3, 1, 1, 3), (10, 0, 0, 10), (5, 5, 5, 5), (0, 4, 2, 9), (40, 60, 55, 45)]
    df = spark.createDataFrame(tables_, "a long, b long, c long, d long").coalesce(1)

    def fisher(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        p = {k: math.comb(col, k) * math.comb(n - col, row - k) / math.comb(n, row) for k in range(max(0, row + col - n), min(row, col) + 1)}
        return sum(x for x in p.values() if x <= p[a] * (1 + 1e-7))

    got = [r[0] for r in df.select(expression.fisher_exact("a", "b", "c", "d")).collect()]
    assert got == pytest.approx([fisher(*t) for t in tables_])
    q = [r for r in df.select(expression.chi_square(*map(F.col, "abcd")).alias("q")).select("q", expression.chi_square_p("q").alias("p")).collect()]
    assert [r["p"] for r in q] == pytest.approx([2.0 if r["q"] < 0 else math.erfc(math.sqrt(r["q"] / 2)) for r in q])
    assert q[0]["q"] == -1 and q[4]["q"] == pytest.approx(4.5113, abs=1e-3)


def test_bootstrap(spark):
    df = spark.createDataFrame([("g", i * 7 % 30, i * 7 % 30 + i % 3) for i in range(1, 40)] + [("z", 0, 0)], "gene string, x long, y long")
    out = {r["gene"]: r for r in expression.bootstrap_pearson(df, "gene", "x", "y", 50).collect()}
    again = {r["gene"]: r for r in expression.bootstrap_pearson(df.repartition(3), "gene", "x", "y", 50).collect()}
    plain = {r["gene"]: r["r"] for r in expression.laplace_pearson(df, ["gene"], "x", "y").collect()}
    assert out["g"]["low"] <= out["g"]["median"] <= out["g"]["high"] and out["g"]["r"] == pytest.approx(plain["g"]) and out["g"] == again["g"]
    assert out["z"]["r"] == 0


def test_matched_points(spark, rng):
    a, b = ([(rng.choice("xy"), rng.randint(0, 300)) for _ in range(40)] for _ in "ab")
    out = rows(series.matched_points(*(spark.createDataFrame(v, "k string, p long") for v in (a, b)), "k", "p", 6))
    want = []
    for k in "xy":
        left, right = sorted(p for c, p in a if c == k), sorted(p for c, p in b if c == k)
        i = j = 0
        while i < len(left) and j < len(right):
            if right[j] > left[i] + 6:
                i += 1
            elif right[j] < left[i] - 6:
                j += 1
            else:
                want.append((k, left[i], right[j]))
                i, j = i + 1, j + 1
    assert out == sorted(want, key=repr)


def test_text_functions(spark):
    one = lambda f, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(f(*[F.col(f"c{i}") for i in range(len(v))])).first()[0]
    assert one(Q.unescaped, r"a\nb\:c\\d\q\W\!") == "a\nb:c\\d\\q \\!"
    assert one(Q.unescaped, "x\\") == "x\\"
    assert [one(Q.evidence_bit, v) for v in ("IMP", " iea ", "ND", "??")] == [1, 64, 512, 0]
    assert one(Q.bare_words, ' "a  b" \'c\' ') == "a b c"
    assert one(lambda c: Q.with_suffix(c, ".x"), "/a.b/c.txt") == "/a.b/c.x.txt"
    assert one(lambda c: Q.with_suffix(c, ".x"), "/a.b/c") == "/a.b/c.x"
    assert sorted(one(lambda c: Q.shuffled(c, 3), "hello world")) == sorted("hello world")
    w = one(lambda c: Q.shuffled_within(c, 3, 4), "abcdefghij")
    assert [sorted(w[i : i + 4]) for i in (0, 4, 8)] == [list("abcd"), list("efgh"), list("ij")]
    assert one(Q.packed, "ACGTn") == "0123cf" and one(Q.unpacked, "0123cf") == "ACGTn"
    assert one(lambda c: search.shorter_runs(c, 2), "AAAACCGTTT") == "AACCGTT"


def test_overlap_class(spark):
    cases = {(0, 9, 10, 5, 14, 30): "contained", (5, 14, 30, 0, 9, 10): "contains", (20, 29, 30, 0, 9, 40): "overlapping", (10, 15, 40, 10, 15, 40): "artefact"}
    for v, name in cases.items():
        assert spark.range(1).select(search.overlap_class(*map(F.lit, v), 1)).first()[0] == name


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 4), (1, 3, 1), (3, 4, 2), (5, 6, 1), (6, 7, 1), (8, 7, 1)], "a long, b long, size long")
    assert rows(assembly.reduced_edges(e), "a", "b") == [(1, 2), (2, 3), (3, 4), (5, 6), (6, 7), (8, 7)]
    assert rows(assembly.highest_paths(e), "node", "score", "hops") == [(1, 0, 0), (2, 5, 1), (3, 9, 2), (4, 11, 3), (5, 0, 0), (6, 1, 1), (7, 2, 2), (8, 0, 0)]
    assert rows(assembly.chains(assembly.reduced_edges(e)), "chain", "node") == [(1, 1), (1, 2), (1, 3), (1, 4), (5, 5), (5, 6)]
    with pytest.raises(ValueError):
        assembly.highest_paths(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "a long, b long, size long"))
    pairs = spark.createDataFrame([("a", "b", 3), ("b", "a", 5), ("a", "c", 1), ("c", "d", 2), ("d", "c", 2)], "contig1 string, contig2 string, gap long")
    s = assembly.scaffold_edges(pairs, 2)
    assert rows(s) == [("a", "b", 2, 4.0), ("c", "d", 2, 2.0)]
    assert rows(assembly.scaffold_sets(s)) == [("a", 2, 1), ("c", 2, 1)]


def test_ontology(spark):
    e = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "a"), ("c", "d")], "child string, parent string")
    assert rows(ontology.ancestors(e)) == [("b", "a"), ("c", "a"), ("c", "b"), ("c", "d"), ("d", "a")]
    with pytest.raises(ValueError):
        ontology.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"))
    g = spark.createDataFrame([("g1", "c"), ("g1", "b"), ("g2", "d")], "gene string, term string")
    assert rows(ontology.genes_per_term(g, e), "term", "gene") == [("a", "g1"), ("a", "g2"), ("b", "g1"), ("c", "g1"), ("d", "g1"), ("d", "g2")]
    h = spark.createDataFrame([("X", 1.0), ("x ", 3.0), ("y", None)], "gene string, weight double")
    assert rows(ontology.weight_reduced(h)) == [("x", 3.0), ("y", 1.0)]


def test_haplotype_ties(spark):
    c = spark.createDataFrame([("1", 5, s, a) for s, a in ((1, 7), (2, 8), (3, 8), (4, 7), (5, None))], "chrom string, locus long, sample long, allele int")
    assert rows(haplotypes.modal_allele(c, ["chrom", "locus"])) == [("1", 5, 8, 2)]  # 8 reaches two first
    g = spark.createDataFrame([(s, "x" if s < 4 else "y") for s in range(1, 6)], "sample long, grp string")
    assert rows(haplotypes.group_consensus(c, g, 2, 0.6), "grp", "allele") == [("x", 8), ("y", haplotypes.SMALL)]
    assert rows(haplotypes.group_consensus(c, g, 2, 0.9), "grp", "allele") == [("x", haplotypes.MIXED), ("y", haplotypes.SMALL)]


def test_gene_of_prefers_the_smallest_holder(spark):
    l = spark.createDataFrame([(1, "a", 50, 55), (2, "a", 5, 8), (3, "a", 205, 210), (4, "a", 400, 401)], "src long, chrom string, s long, e long")
    g = spark.createDataFrame([("a", 10, 200, "+", "big"), ("a", 40, 60, "-", "small")], "chrom string, s long, e long, strand string, name string")
    assert rows(genes.gene_of(l, g, 10)) == [(1, "small", 0), (2, "big", 1), (3, "big", 2)]


def test_gene_functions_without_coding_span(spark):
    df = spark.range(1).select(F.array(F.struct(F.lit(10).alias("s"), F.lit(19).alias("e")), F.struct(F.lit(30).alias("s"), F.lit(39).alias("e"))).alias("x"))
    x, same = F.col("x"), F.lit(10)
    assert tuple(df.select(G.transcribed_length(x), G.cds_length(x, same, same), G.utr5_length(x, same, same, F.lit("+")), G.n_introns(x)).first()) == (20, 0, 0, 1)
    assert tuple(df.select(G.utr5_length(x, F.lit(15), F.lit(32), F.lit("+")), G.utr3_length(x, F.lit(15), F.lit(32), F.lit("+")), G.utr5_length(x, F.lit(15), F.lit(32), F.lit("-"))).first()) == (5, 7, 7)


def test_simulation(spark):
    whole = {}
    for r in simulate.genome(spark, 2, 1500, 3).orderBy("chrom", "start").collect():
        whole[r["chrom"]] = whole.get(r["chrom"], "") + r["seq"]
    assert [len(v) for v in whole.values()] == [1500, 1500] and set("".join(whole.values())) == set("ACGT")
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for r in simulate.reads(spark, 40, 2, 1500, 30, 0.0, 3, 8).collect():
        seq = r["seq"] if r["strand"] == "+" else flip(r["seq"])
        assert seq == whole[r["chrom"]][r["start"] : r["start"] + 30] and r["subs"] == 0
    for r in simulate.read_pairs(spark, 20, 2, 1500, 25, 60, 90, 3, 8).collect():
        part = whole[r["chrom"]][r["start"] : r["start"] + r["insert"]]
        assert 60 <= r["insert"] <= 90 and r["seq1"] == part[:25] and flip(r["seq2"]) == part[-25:]
    for rate in (0.3, 4.0, 60.0):
        v = [r[0] for r in spark.range(2000).select(simulate.poisson(F.lit(rate), 1, F.col("id"))).collect()]
        mean = sum(v) / len(v)
        assert mean == pytest.approx(rate, rel=0.12) and sum((x - mean) ** 2 for x in v) / len(v) == pytest.approx(rate, rel=0.2)
    logs = [r[0] for r in spark.range(0, 1000, 37).select(simulate.log_factorial(F.col("id"))).collect()]
    assert logs == pytest.approx([math.lgamma(n + 1) for n in range(0, 1000, 37)])


def test_resampled_draws_are_rows(spark):
    df = spark.createDataFrame([(i, i * 2) for i in range(30)], "id long, v long")
    out = simulate.resampled(df, ["id"], 3, 1).collect()
    assert len(out) == 90 and Counter(r["round"] for r in out) == {0: 30, 1: 30, 2: 30} and all(r["v"] == 2 * r["id"] for r in out)


def test_chains_and_matches(spark, rng):
    t = "".join(rng.choice("ACGT") for _ in range(300))
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    q = t[40:80] + t[90:130]  # ten bases are missing
    targets = spark.createDataFrame([(1, t), (2, "".join(rng.choice("ACGT") for _ in range(300)))], "id long, seq string")
    queries = spark.createDataFrame([(7, q), (8, flip(t[200:260]))], "id long, seq string")
    out = {r["query"]: r for r in search.local_matches(queries, targets, 8, 30, 1).collect()}
    a, b = out[7], out[8]
    assert (a["target"], a["strand"], a["q_s"], a["q_e"], a["t_s"], a["t_e"], a["nodes"]) == (1, "+", 0, 79, 40, 129, 2) and a["score"] == pytest.approx(79)
    assert (b["target"], b["strand"], b["t_s"], b["t_e"], b["score"]) == (1, "-", 200, 259, 60)


def test_unique_flanks(spark):
    seqs = spark.createDataFrame([(1, "AACCGGTTAACCAAT"), (2, "AACCG")], "id long, seq string")
    sites = spark.createDataFrame([(10, 1, 2), (11, 1, 6), (12, 1, 0)], "site long, id long, at long")
    assert rows(search.flanks(sites, seqs, 2, 1), "site", "flank") == [(10, "AACC"), (11, "GGTT"), (12, None)]
    assert rows(search.unique_flanks(sites, seqs, 2, 1), "site", "flank") == [(11, "GGTT")]


def test_start_profile_gathers_nothing_in_the_driver(spark):
    d = catalog.queries()["start_profile"](spark, "/root/testdata/sf0.001")
    d.collect()
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def shuffled(spark, f):
    """What f returns and how many rows it shuffled."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = f()
    return out, sum(n for k, n in stages().items() if k not in before)


def halves_and_thirds(spark, n):
    k = spark.range(1, n).select(F.col("id").alias("child"))
    return k.select("child", F.explode(F.array(F.floor(F.col("child") / 2), F.floor(F.col("child") / 3))).alias("parent")).filter("parent > 0").distinct()


def up_from(edges):
    parents = {}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
    above = {}
    for c in sorted(parents, reverse=True):  # parents are larger
        above[c] = set().union(*[{p} | above.get(p, set()) for p in parents[c]])
    return above


def test_ancestors_shuffle_about_the_rows_there_are(spark):
    up, n = shuffled(spark, lambda: ontology.ancestors(halves_and_thirds(spark, 3000)).count())
    assert n < 2 * up


def test_ancestors_in_slices_and_by_pairs(spark, rng, monkeypatch):
    pairs = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a < b} | {(i, i + 1) for i in range(60, 130)}
    e = spark.createDataFrame(sorted(pairs) + [(3, None), (7, None)], "child long, parent long")
    above = up_from(pairs)
    want = {(c, p) for c, all_ in above.items() for p in all_}
    want |= {(c, None) for c in {3, 7} | {c for c, all_ in above.items() if all_ & {3, 7}}}
    monkeypatch.setattr(ontology, "SLICE", 4)
    for most in (10**6, 60, 1):
        got = rows(ontology.ancestors(e, most=most))
        assert got == sorted(want, key=repr)
    for circle in ([(1, 2), (2, 3), (3, 1)], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 1)], [(1, 1)]):
        with pytest.raises(ValueError):
            ontology.ancestors(spark.createDataFrame(circle, "child long, parent long"))


def test_gene_counts_shuffle_sets_and_not_pairs(spark):
    e = halves_and_thirds(spark, 1000)
    a = spark.range(60_000).select((F.col("id") % 600).alias("gene"), (F.col("id") * 7 % 999 + 1).alias("term"))
    pairs = ontology.genes_per_term(a, e).count()
    d, n = shuffled(spark, lambda: catalog_like("term_genes", spark, a, e))
    assert sum(r["genes"] for r in d) == pairs
    assert n < pairs


def test_enrichment_shuffles_sets_and_not_pairs(spark):
    e = halves_and_thirds(spark, 1000)
    a = spark.range(60_000).select((F.col("id") % 600).alias("gene"), (F.col("id") * 7 % 999 + 1).alias("term"))
    pairs = ontology.genes_per_term(a, e).count()
    d, n = shuffled(spark, lambda: catalog_like("term_enrichment", spark, a, e))
    assert sum(r["n1"] for r in d) == pairs
    assert n < pairs


def catalog_like(name, spark, a, e):
    """Rows of a query over these annotations and edges."""
    from lociflow.plans import expression_queries as Q

    with pytest.MonkeyPatch.context() as m:
        m.setattr(Q, "annotations", lambda *_: a)
        m.setattr(Q, "terms", lambda *_: e)
        return catalog.queries()[name](spark, "").collect()


def test_gene_sets_against_brute_force(spark, rng):
    pairs = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(80)) if a < b}
    direct = [(f"g{rng.randrange(1500)}", rng.randrange(45)) for _ in range(3000)] + [(None, 3), ("g1", None)]
    e, a = spark.createDataFrame(sorted(pairs), "child long, parent long"), spark.createDataFrame(direct, "gene string, term long").repartition(5)
    above = up_from(pairs)
    per = {(t, g) for g, t in direct} | {(t, g) for g, u in direct for t in above.get(u, ())}
    assert rows(ontology.genes_per_term(a, e), "term", "gene") == sorted(per, key=repr)
    assert rows(ontology.gene_counts(a, e), "term", "genes") == sorted(Counter(t for t, _ in per).items(), key=repr)
    sample = spark.createDataFrame([(f"g{i}",) for i in range(0, 2000, 9)], "gene string")
    assert rows(ontology.enriched(a, e, sample)) == rows(ontology.enrichment(ontology.genes_per_term(a, e), sample))

