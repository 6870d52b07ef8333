"""Toxicity (9): a bidirectional gated recurrent network with attention pooling, in numpy.

Text is lower-cased and split at white space. A word enters by itself (a hashed embedding) and by its
characters (hashed embeddings of its 3- and 5-grams, boundaries included), each with the log odds of
its document frequencies in the training sample. Windows of WINDOW words start every STRIDE words and
cover the whole text; each is read in both directions by gated recurrent units, whose states are
pooled by attention. A document's score is that of its highest window.

Training is on a bounded sample of labelled rows: at most MOST_TOXIC and MOST_CLEAN documents, those of
least hash of their doc_id, never a held-out one. One task trains, and sends the weights to the driver. Labels are of documents, so each epoch scores all
windows of the sample and learns from each document's highest window and one other.

Nulls: a null text is empty and gets the score of a window without words. A null doc_id is not held
out. Without labelled rows of both kinds every score is 0. Rows that share a doc_id are scored one by one;
of those that share a labelled one the least text is learnt from. Ties between windows fall to the last. An empty
table gives no rows. Very long texts are read whole, window by window. Other columns are not looked at.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, narrow, release, slices, spread, table, texts

WINDOW, STRIDE, HIDDEN = 32, 16, 8
WORD_ROWS, GRAM_ROWS, ODDS_ROWS, WORD_DIM, GRAM_DIM = 1 << 12, 1 << 12, 1 << 17, 4, 6
MOST_TOXIC, MOST_CLEAN, EPOCHS, LEAST_STEPS, BATCH, RATE, THRESHOLD = 1200, 2400, 4, 120, 256, 0.01, 0.3
GRAMS = (3, 5)
#: Distinct words whose grams are looked up at once.
CHUNK = 50_000
INPUTS = WORD_DIM + GRAM_DIM + 3


@dataclass
class Words:
    """Distinct words as table rows: their own hash, and the hashes of their character grams."""

    word: np.ndarray
    gram: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(distinct: pa.Array) -> Words:
        parts = [Words._of(distinct.slice(at, CHUNK)) for at in range(0, len(distinct), CHUNK)] or [Words._of(distinct)]
        word, gram, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Words(word, gram, np.cumsum(counts) - counts, counts)

    @staticmethod
    def _of(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, gram, counts) of some words."""
        bare = pc.replace_substring_regex(distinct.cast(pa.large_string()), r"^[^\pL\pN]+|[^\pL\pN]+$", "")
        data, offsets = texts(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), bare, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))
        n, lengths = len(distinct), np.diff(offsets)
        place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
        power = np.cumprod(np.full(int(lengths.max(initial=1)) + 1, 0x100000001B3, dtype=np.uint64))
        mixed = (data.astype(np.uint64) + np.uint64(1)) * power[place]
        word = np.add.reduceat(mixed, offsets[:-1]) if n else np.zeros(0, np.uint64)
        wide = np.concatenate((data, np.zeros(8, np.uint8)))
        rest = np.repeat(offsets[1:], lengths) - np.arange(len(data))
        owner = np.repeat(np.arange(n), lengths)
        grams, owners = [], []
        for size in GRAMS:
            at = np.flatnonzero(rest >= size)
            h = np.full(len(at), size, dtype=np.uint64)
            for k in range(size):
                h = h * np.uint64(0x100000001B3) + wide[at + k]
            grams.append(h)
            owners.append(owner[at])
        gram, owner = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return _finish(word), _finish(gram[order]), np.bincount(owner, minlength=n)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)).astype(np.int32)  # 24 bits


@dataclass
class Model:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    word_odds: np.ndarray | None = None
    gram_odds: np.ndarray | None = None

    def sums(self, w: Words, values: np.ndarray, how) -> np.ndarray:
        """how over each word's grams; 0 where it has none."""
        out = np.zeros((len(w.word), *values.shape[1:]), dtype=np.float32)
        some = w.counts > 0
        if some.any():
            out[some] = how.reduceat(values, w.starts[some], axis=0)
        return out

    def inputs(self, w: Words) -> np.ndarray:
        """The input row of every distinct word, and one of zeros at the end for no word."""
        x = np.zeros((len(w.word) + 1, INPUTS), dtype=np.float32)
        for at in range(0, len(w.word), CHUNK):
            to = min(at + CHUNK, len(w.word))
            first = int(w.starts[at])
            some = Words(w.word[at:to], w.gram[first : int(w.starts[to - 1] + w.counts[to - 1])], w.starts[at:to] - first, w.counts[at:to])
            p, scale, rows = self.p, 1 / np.maximum(some.counts, 1)[:, None].astype(np.float32), x[at:to]
            odds = self.gram_odds[some.gram % ODDS_ROWS]
            rows[:, :WORD_DIM] = p["word"][some.word % WORD_ROWS]
            rows[:, WORD_DIM : WORD_DIM + GRAM_DIM] = self.sums(some, p["gram"][some.gram % GRAM_ROWS], np.add) * scale
            rows[:, -3] = self.word_odds[some.word % ODDS_ROWS]
            rows[:, -2] = self.sums(some, odds, np.maximum)
            rows[:, -1] = self.sums(some, odds, np.add) * scale[:, 0]
        return x

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        """What every input row gives to the units of both directions."""
        return [x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in (0, 1)]

    def logits(self, x: np.ndarray, windows: np.ndarray) -> np.ndarray:
        parts = self.parts(x)
        return np.concatenate([self.run(x, windows[a : a + 2048], parts=parts) for a in range(0, len(windows), 2048)])

    def run(self, x: np.ndarray, windows: np.ndarray, keep: bool = False, parts: list[np.ndarray] | None = None):
        """Logits of windows (rows of x; the last row: no word), and what the backward pass needs."""
        parts = parts or self.parts(x)
        p, none = self.p, len(x) - 1
        n, t = windows.shape
        states = np.zeros((t, n, 2 * HIDDEN), dtype=np.float32)
        mask = (windows.T != none).astype(np.float32)[:, :, None]
        tape = []
        for d, steps in ((0, range(t)), (1, range(t - 1, -1, -1))):
            part, u = parts[d], p[f"u{d}"]
            h = np.zeros((n, HIDDEN), dtype=np.float32)
            for s in steps:
                a, b = part[windows[:, s]], h @ u
                zr = 1 / (1 + np.exp(-(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])))
                z, r, q = zr[:, :HIDDEN], zr[:, HIDDEN:], b[:, 2 * HIDDEN :]
                c = np.tanh(a[:, 2 * HIDDEN :] + r * q)
                new = h + mask[s] * (1 - z) * (c - h)
                if keep:
                    tape.append((d, s, h, z, r, q, c))
                h = new
                states[s, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        e = states @ p["v"]
        e = np.where(mask[:, :, 0] > 0, e, -30)
        alpha = np.exp(e - e.max(axis=0))
        alpha /= alpha.sum(axis=0)
        pooled = (alpha[:, :, None] * states).sum(axis=0)
        logit = pooled @ p["o"] + p["ob"][0]
        return (logit, (states, mask, tape, alpha, pooled)) if keep else logit

    def gradient(self, x, windows, target, weight):
        """Gradients of the mean weighted log loss for all parameters and for x."""
        p = self.p
        logit, (states, mask, tape, alpha, pooled) = self.run(x, windows, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        dl = (1 / (1 + np.exp(-logit)) - target) * weight / len(target)
        g["o"], g["ob"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dp = dl[:, None] * p["o"]
        ds = alpha[:, :, None] * dp
        da = (states * dp).sum(axis=2)
        de = alpha * (da - (alpha * da).sum(axis=0)) * mask[:, :, 0]
        g["v"] = np.einsum("tnh,tn->h", states, de)
        ds += de[:, :, None] * p["v"]
        dx = np.zeros_like(x)
        carry = {0: 0.0, 1: 0.0}
        for d, s, h, z, r, q, c in reversed(tape):
            dh = ds[s, :, d * HIDDEN : (d + 1) * HIDDEN] + carry[d]
            m = mask[s]
            dz, dc = -m * dh * (c - h) * z * (1 - z), m * dh * (1 - z) * (1 - c * c)
            dr = dc * q * r * (1 - r)
            inner = np.concatenate((dz, dr, dc), axis=1)
            outer = np.concatenate((dz, dr, dc * r), axis=1)
            carry[d] = dh * (1 - m * (1 - z)) + outer @ p[f"u{d}"].T
            g[f"u{d}"] += h.T @ outer
            g[f"b{d}"] += inner.sum(axis=0)
            rows = windows[:, s]
            g[f"w{d}"] += x[rows].T @ inner
            np.add.at(dx, rows, inner @ p[f"w{d}"].T)
        return g, dx


def fresh_model(seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    r = lambda *shape, s=0.2: rng.normal(0, s, shape).astype(np.float32)
    p = {"word": r(WORD_ROWS, WORD_DIM, s=0.05), "gram": r(GRAM_ROWS, GRAM_DIM, s=0.05), "v": r(2 * HIDDEN), "o": r(2 * HIDDEN), "ob": np.full(1, -1, np.float32)}
    for d in (0, 1):
        p |= {f"w{d}": r(INPUTS, 3 * HIDDEN), f"u{d}": r(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    return Model(p)


def windows_of(codes: np.ndarray, counts: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, text of each window): all overlapping windows of every text; one at least."""
    per_text = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), per_text)
    first = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = (first * STRIDE)[:, None] + np.arange(WINDOW)
    inside = at < counts[text][:, None]
    source = np.append(codes, none)
    return source[np.where(inside, at + (np.cumsum(counts) - counts)[text][:, None], len(codes))], text


def read(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, windows, text of each window, code of each word) of a text column."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
    # A text of white space at an end gives empty words there; they read as words without characters.
    flat = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = flat.indices.to_numpy().astype(np.int64)
    words = Words.of(flat.dictionary)
    return words, *windows_of(codes, counts, len(words.word)), codes


def highest(logit: np.ndarray, text: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(logit, np.flatnonzero(np.diff(text, prepend=-1))) if len(text) else logit


def log_odds(parts, toxic: np.ndarray) -> np.ndarray:
    """Log odds of the document frequencies of each table row; 0 where fewer than four documents have it.

    parts: (table rows, document of each) of some whole documents at a time.
    """
    t, c = np.zeros(ODDS_ROWS), np.zeros(ODDS_ROWS)
    for rows, doc in parts:
        pair = np.unique(doc * ODDS_ROWS + rows % ODDS_ROWS)
        d, r = pair // ODDS_ROWS, pair % ODDS_ROWS
        t += np.bincount(r[toxic[d]], minlength=ODDS_ROWS)
        c += np.bincount(r[~toxic[d]], minlength=ODDS_ROWS)
    odds = np.log((t + 0.5) / (toxic.sum() + 1)) - np.log((c + 0.5) / ((~toxic).sum() + 1))
    return np.where(t + c >= 4, np.clip(odds, -1, 4), 0).astype(np.float32)


def document_parts(doc: np.ndarray, n_docs: int, at_once: int = 64) -> list[slice]:
    """Where some documents at a time stand in ascending numbers of documents."""
    edges = np.searchsorted(doc, [*range(0, n_docs, at_once), n_docs])
    return [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def train(column: pa.Array, toxic: np.ndarray, seed: int = 0) -> Model | None:
    """Fit on texts and their labels; None without both kinds."""
    toxic = toxic.astype(bool)
    if toxic.all() or not toxic.any():
        return None
    rng = np.random.default_rng(seed)
    words, windows, text, codes = read(column)
    windows = windows.astype(np.int32)
    release()
    model = fresh_model(seed)
    counts = pc.list_value_length(pc.ascii_split_whitespace(pc.fill_null(column, ""))).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(column)), counts)
    model.word_odds = log_odds(((words.word[codes[p]], doc[p]) for p in document_parts(doc, len(column))), toxic)
    pair = np.unique(doc * len(words.word) + codes)
    doc, codes = pair // len(words.word), (pair % len(words.word)).astype(np.int32)
    del pair
    grams = ((words.gram[spread(words.starts[codes[p]], words.counts[codes[p]])], np.repeat(doc[p], words.counts[codes[p]])) for p in document_parts(doc, len(column)))
    model.gram_odds = log_odds(grams, toxic)
    del doc, codes
    release()
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    edges = np.flatnonzero(np.diff(text, prepend=-1))
    sizes = np.diff(np.append(edges, len(text)))
    step = 0
    each = len(edges) + int((~toxic).sum())
    for epoch in range(max(EPOCHS, -(-LEAST_STEPS // -(-each // BATCH)))):  # a small sample is seen more often
        x = model.inputs(words)
        if epoch:
            logit = model.logits(x, windows)
        else:  # before the network knows anything: the window of highest odds
            logit = np.concatenate([x[:, -2][windows[a : a + 8192]].max(axis=1) for a in range(0, len(windows), 8192)])
        by = np.lexsort((logit, text))
        top = by[np.append(edges[1:], len(text)) - 1]
        other = edges + (rng.random(len(edges)) * sizes).astype(np.int64)
        # The highest windows carry the label; other windows of clean documents are clean.
        chosen = np.concatenate((top, other[~toxic]))
        target = np.concatenate((toxic, np.zeros((~toxic).sum()))).astype(np.float32)
        order = rng.permutation(len(chosen))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            step += 1
            model = _step(model, words, windows[chosen[some]], target[some], state, step)
    return model


def _step(model: Model, words: Words, windows: np.ndarray, target: np.ndarray, state: dict, step: int) -> Model:
    used, rows = np.unique(windows, return_inverse=True)
    rows, none = rows.reshape(windows.shape), len(words.word)
    real = used[used != none]
    n = words.counts[real]
    gram = words.gram[np.repeat(words.starts[real] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    some = Words(words.word[real], gram, np.cumsum(n) - n, n)
    x = model.inputs(some)  # its last row stands for no word, as `used` ends with it
    weight = np.where(target > 0, 1.5, 1).astype(np.float32)
    g, dx = model.gradient(x, rows, target, weight)
    g["word"], g["gram"] = np.zeros_like(model.p["word"]), np.zeros_like(model.p["gram"])
    np.add.at(g["word"], some.word % WORD_ROWS, dx[:-1, :WORD_DIM])
    np.add.at(g["gram"], gram % GRAM_ROWS, np.repeat(dx[:-1, WORD_DIM : WORD_DIM + GRAM_DIM] / np.maximum(n, 1)[:, None], n, axis=0))
    for k, v in model.p.items():
        m, s = state[k]
        m += 0.1 * (g[k] - m)
        s += 0.01 * (g[k] ** 2 - s)
        v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return model


def scores(model: Model | None, column: pa.Array) -> np.ndarray:
    """The score of every text."""
    if model is None:
        return np.zeros(len(column))
    words, windows, text, _ = read(column)
    x = model.inputs(words)
    logit = model.logits(x, windows)
    return 1 / (1 + np.exp(-highest(logit, text).astype(np.float64)))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on the bounded sample of labelled documents that are not held out."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    some = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    rows = [tuple(r) for s in some for r in s.collect()]  # MOST_TOXIC + MOST_CLEAN rows at most
    if not rows:
        return None
    sample = spark.createDataFrame(rows, "doc_id long, toxic int")
    # Of rows that share a labelled doc_id the least text is taken.
    found = narrow(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def learn(batches):
        some = [b for b in batches if b.num_rows]
        got = pa.Table.from_batches(some) if some else None
        model = train(got["text"].combine_chunks(), got["toxic"].to_numpy()) if got else None
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # One task trains on the bounded sample; its texts never come to the driver. A lost task trains the same again.
    models = [r["model"] for r in found.coalesce(1).sortWithinPartitions("doc_id").mapInArrow(lean(learn), "model binary").collect()]
    return pickle.loads(models[0]) if models else None


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in slices(batches, "text", 3 << 20):
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "held_out": pa.array([held_out(i) for i in ids.to_pylist()]), "score": pa.array(scores(sent.value, batch.column("text")))})

    return narrow(docs).mapInArrow(lean(score), "doc_id long, held_out boolean, score double")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def keep(batches):
        for batch in slices(batches, "text", 3 << 20):
            yield batch.filter(pa.array(scores(sent.value, batch.column("text")) < THRESHOLD))

    return docs.mapInArrow(lean(keep), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
