"""Kernels, bit sets, result tables, contigs and simulations by their properties."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.functions import bits, kernels
from lociflow.operators import assembly, haplotypes, simulate
from lociflow.sources import formats, relational


def doublets(s):
    return Counter(zip(s[:-1], s[1:], strict=True))


def test_shuffles(spark):
    rng = random.Random(1)
    texts = ["", "A", "AC", "ACA"] + ["".join(rng.choice("ACGT") for _ in range(n)) for n in (5, 40, 300)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "s string").coalesce(1)
    out = [tuple(r) for r in df.select("s", kernels.doublet_shuffled(F.col("s"), 7), kernels.chain_shuffled(F.col("s"), 7)).collect()]
    for s, d, c in out[:-1]:
        assert doublets(s) == doublets(d) and d[:1] == s[:1] and d[-1:] == s[-1:]
        assert len(c) == len(s) and set(c) <= set(s)
    assert out[-1] == (None, None, None) and out[-2][0] != out[-2][1]
    assert out == [tuple(r) for r in df.repartition(3).select("s", kernels.doublet_shuffled(F.col("s"), 7), kernels.chain_shuffled(F.col("s"), 7)).orderBy(F.expr("s IS NULL"), F.length("s"), F.expr(f"array_position(array({', '.join(repr(t) for t in texts)}), s)")).collect()]


def test_suffix_array(spark):
    texts = ["", "a", "banana", "aaaaaa", "mississippi", "".join(random.Random(2).choice("ab") for _ in range(200))]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1).select(kernels.suffix_array("s")).collect()]
    assert out == [sorted(range(len(t)), key=lambda i, t=t: t[i:]) for t in texts]


def test_affine_distance(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("AC") for _ in range(rng.randint(0, 7))), "".join(rng.choice("AC") for _ in range(rng.randint(0, 7)))) for _ in range(40)]
    plain = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(kernels.affine_distance(F.col("a"), F.col("b"), 0, 1, 0, 1)).collect()]
    edit = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(F.levenshtein("a", "b")).collect()]
    assert plain == edit  # without a cost to open, gaps are single edits
    one = spark.createDataFrame([("AAAA", "AACCAA"), (None, "A")], "a string, b string").coalesce(1)
    assert [r[0] for r in one.select(kernels.affine_distance(F.col("a"), F.col("b"), 0, 9, 2, 1)).collect()] == [4, None]


def test_bit_sets(spark):
    rng = random.Random(4)
    sets = [(sorted(rng.sample(range(300), 40)), sorted(rng.sample(range(300), 70))) for _ in range(5)] + [([], [0, 63, 64, 127, 299])]
    df = spark.createDataFrame(sets, "a array<int>, b array<int>").coalesce(1)
    a, b = bits.of(F.col("a"), 300), bits.of(F.col("b"), 300)
    out = df.select(bits.members(bits.union(a, b)), bits.members(bits.intersection(a, b)), bits.members(bits.difference(a, b)), bits.size(b), bits.has(b, F.lit(63))).collect()
    assert [tuple(r) for r in out] == [(sorted({*x, *y}), sorted({*x} & {*y}), sorted({*x} - {*y}), len(y), 63 in y) for x, y in sets]
    assert spark.range(1).select(bits.members(bits.empty(100))).first()[0] == []


def test_stationary():
    x = kernels.stationary(np.array([[8, 2], [4, 6]]))
    assert x == pytest.approx([2 / 3, 1 / 3]) and kernels.stationary(np.array([[0, 1], [1, 0]])) == pytest.approx([0.5, 0.5])


def test_gamma_and_evolution(spark):
    v = np.array([r[0] for r in spark.range(3000).select(kernels.gamma(F.lit(3.0), F.lit(2.0), F.col("id"), 5)).collect()])
    assert v.mean() == pytest.approx(6, rel=0.06) and v.var() == pytest.approx(12, rel=0.15)
    s = "ACGTN" * 200
    out = [r[0] for r in spark.range(20).select(kernels.evolved(F.lit(s), F.col("id"), 0.1, 5)).collect()]
    changed = [sum(a != b for a, b in zip(s, o, strict=True)) for o in out]
    assert all(o[4::5] == "N" * 200 for o in out) and np.mean(changed) == pytest.approx(80, rel=0.2) and len(set(out)) == 20


def test_contigs(spark):
    seqs = spark.createDataFrame([("a", "ACGTAC"), ("b", "TACGG"), ("c", "GGTTT"), ("d", "CCCC")], "id string, seq string")
    overlaps = spark.createDataFrame([("a", "b", 3), ("b", "c", 2), ("a", "a", 6)], "a string, b string, size long")
    assert sorted(tuple(r) for r in assembly.contigs(seqs, overlaps).collect()) == [("a", 3, "ACGTACGGTTT"), ("d", 1, "CCCC")]


def test_fragments_and_counts(spark):
    out = simulate.fragments(spark, 60, 2, 3000, 40, 60, {"AA": 1.0, "AC": 0.5}, 3, 9).collect()
    assert len(out) > 40 and all(r["seq"][:2] in ("AA", "AC") and 40 <= r["length"] == len(r["seq"]) <= 60 for r in out)
    c = simulate.expression_counts(spark, 200, 6, 20.0, 0.3, 4.0, 1).toPandas()
    assert len(c) == 1200 and c.groupby("gene").rate.nunique().isin([1, 2]).all() and c.n.mean() == pytest.approx(c.rate.mean(), rel=0.05)


def test_grouped_samples(spark):
    diffs = spark.createDataFrame([("1", 0, "a", "b", 1), ("1", 0, "a", "c", 9), ("1", 0, "b", "c", 2), ("1", 0, "c", "d", 2), ("1", 0, "a", "d", 9), ("1", 0, "b", "d", 9)], "chrom string, bin long, a string, b string, diffs long")
    samples = spark.createDataFrame([(x,) for x in "abcde"], "sample string")
    out = sorted((r["sample"], r["grp"]) for r in haplotypes.grouped_samples(diffs, samples, 2).collect())
    assert out == [("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]  # b has a and c; then d and e are alone


def test_relational(spark, tmp_path):
    p = spark.createDataFrame([tuple([100, 4, 0, 0, 1, 2, 1, 3] + ["+", "q", 120, 0, 105, "t", 900, 10, 116, 2, [60, 44], [0, 62], [10, 73]]), tuple([50] + [0] * 7 + ["-", "q", 120, 0, 49, "t", 900, 500, 549, 1, [50], [0], [500]])], ", ".join(f"{n} {'string' if n in ('strand', 'q_name', 't_name') else 'array<long>' if n in ('block_sizes', 'q_starts', 't_starts') else 'long'}" for n in formats.PSL))
    t = relational.alignment_tables(p, "run")
    assert [tuple(r) for r in t["TblAlignments"].select("AlignmentID", "Score", "Identity", "TStart").orderBy("AlignmentID").collect()] == [(1, 94, 96, 10), (2, 50, 100, 500)]
    assert [tuple(r) for r in t["TblAlignmentBlocks"].orderBy("BlockID").select("BlockID", "AlignmentID", "BlockSize", "QStart", "TStart").collect()] == [(1, 1, 60, 0, 10), (2, 1, 44, 62, 73), (3, 2, 50, 0, 500)]
    assert [tuple(r) for r in t["TblAlignSummaries"].orderBy("IsQuery").select("IsQuery", "SeqName", "SeqLen", "NumAlignments").collect()] == [(0, "t", 900, 2), (1, "q", 120, 2)]
    relational.stored(t, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/TblAlignments")).count() == 2
    r = relational.run_record(spark, "e", "p", "1.0", "2020", [("int32", "n", "5")], [("g", "text", "x", "y")], [("g", "a", "1", "b", "2")])
    assert relational.closed(r["TblProcessing"], 1, "2021", 0).first()["Finish"] == "2021" and r["TblXYResults"].count() == 1
    assert relational.by_name(r["TblExprs"], "ExprName", "E").count() == 1
