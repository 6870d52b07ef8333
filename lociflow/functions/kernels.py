"""Functions on sequences that need loops: shuffles that keep doublets, suffix arrays, weighted edits, chains of states. They run in Arrow batches.

All randomness follows from a seed and the sequence, so a lost task gives the same again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType


def _rng(seed: int, text: str) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(text.encode())])


def _doublets(text: str, rng: np.random.Generator) -> str:
    """A random order of the letters with the same counts of all pairs: a random walk that uses every edge once.

    For each letter but the last one a last edge is drawn until these lead to the last letter from everywhere;
    the other edges are put in any order.
    """
    if len(text) < 3:
        return text
    out: dict[str, list[str]] = {}
    for a, b in zip(text[:-1], text[1:], strict=True):
        out.setdefault(a, []).append(b)
    end = text[-1]
    others = [a for a in out if a != end]
    while True:
        last = {a: out[a][rng.integers(len(out[a]))] for a in others}
        for a in others:
            seen, at = set(), a
            while at != end and at not in seen:
                seen.add(at)
                at = last[at]
            if at != end:
                break
        else:
            break
    for a, edges in out.items():
        if a in last:
            edges.remove(last[a])
        rng.shuffle(edges)
        if a in last:
            edges.append(last[a])
    at, walk, used = text[0], [text[0]], dict.fromkeys(out, 0)
    for _ in range(len(text) - 1):
        used[at] += 1
        at = out[at][used[at] - 1]
        walk.append(at)
    return "".join(walk)


def _chain(text: str, rng: np.random.Generator) -> str:
    """Letters drawn one after the other by what follows each in the text; the first is the text's."""
    if len(text) < 2:
        return text
    out: dict[str, list[str]] = {}
    for a, b in zip(text[:-1], text[1:], strict=True):
        out.setdefault(a, []).append(b)
    made = [text[0]]
    while len(made) < len(text):
        after = out.get(made[-1]) or list(text)
        made.append(after[rng.integers(len(after))])
    return "".join(made)


def _text_udf(f):
    def make(seq: Column, seed: int) -> Column:
        @F.pandas_udf(StringType())
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else f(x, _rng(seed, x)))

        return run(seq)

    return make


#: The sequence in another order with the same doublets; and one drawn from its chain of first order. Of (seq, seed).
doublet_shuffled = _text_udf(_doublets)
chain_shuffled = _text_udf(_chain)


def _suffixes(text: str) -> list[int]:
    """Starts of the suffixes in their order, by doubling the length that ranks tell apart."""
    n = len(text)
    rank = np.array([ord(c) for c in text], np.int64)
    order, size = np.argsort(rank, kind="stable"), 1
    while n > 1:
        second = np.full(n, -1, np.int64)
        second[: n - size] = rank[size:] if size < n else []
        order = np.lexsort((second, rank))
        step = np.concatenate(([0], (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        size *= 2
        if rank.max(initial=0) == n - 1 or size >= n:
            break
    return order.tolist()


@F.pandas_udf(ArrayType(IntegerType()))
def suffix_array(seq: pd.Series) -> pd.Series:
    """Starts of all suffixes of a text, from 0, in the order of the suffixes."""
    return seq.map(lambda x: None if x is None else _suffixes(x))


def _affine(a: str, b: str, match: int, mismatch: int, open_: int, extend: int) -> int:
    """Least cost of turning a into b, with a cost for opening a gap and for each of its bases."""
    big = 1 << 40
    m = [0] + [open_ + extend * j for j in range(1, len(b) + 1)]
    gap_a = [big] * (len(b) + 1)
    for i in range(1, len(a) + 1):
        before, m[0] = m[0], open_ + extend * i
        gap_b = big
        for j in range(1, len(b) + 1):
            gap_a[j] = min(gap_a[j] + extend, m[j] + open_ + extend)
            gap_b = min(gap_b + extend, m[j - 1] + open_ + extend)
            best = min(before + (match if a[i - 1] == b[j - 1] else mismatch), gap_a[j], gap_b)
            before, m[j] = m[j], best
    return m[-1]


def affine_distance(a: Column, b: Column, match: int = 0, mismatch: int = 1, open_: int = 2, extend: int = 1) -> Column:
    @F.pandas_udf(LongType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _affine(p, q, match, mismatch, open_, extend) for p, q in zip(x, y, strict=True)], dtype="Int64")

    return run(a, b)


def gamma(shape: Column, scale: Column, key: Column, seed: int) -> Column:
    """A gamma number for each key."""

    @F.pandas_udf(DoubleType())
    def run(k: pd.Series, c: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(n) & (1 << 63) - 1]).gamma(a, b) for a, b, n in zip(k, c, i, strict=True)])

    return run(shape.cast("double"), scale.cast("double"), key.cast("bigint"))


def evolved(seq: Column, key: Column, rate: float, seed: int) -> Column:
    """The sequence with each base changed to another one with chance `rate`."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series, i: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(s, i, strict=True):
            if x is None:
                out.append(None)
                continue
            rng = np.random.default_rng([seed, int(n) & (1 << 63) - 1])
            hit, move = rng.random(len(x)) < rate, rng.integers(1, 4, len(x))
            out.append("".join("ACGT"[("ACGT".index(c) + m) % 4] if h and c in "ACGT" else c for c, h, m in zip(x, hit, move, strict=True)))
        return pd.Series(out)

    return run(seq, key.cast("bigint"))


def stationary(pairs: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The shares of states that a chain with these counts of steps from row to column settles in; rows without steps go anywhere."""
    p = np.asarray(pairs, float)
    total = p.sum(axis=1, keepdims=True)
    p = np.where(total > 0, p / np.where(total > 0, total, 1), 1 / len(p))
    x = np.full(len(p), 1 / len(p))
    for _ in range(rounds):
        new = 0.5 * x + 0.5 * (x @ p)  # half steps: chains that alternate settle too
        if np.abs(new - x).max() < 1e-15:
            break
        x = new
    return x / x.sum()
