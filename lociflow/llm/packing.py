"""Packing (8): sequences of at most `window` tokens, in document order, by dynamic programming.

The ids of a range of documents are one stream. Cuts may fall behind a document, behind a sentence
or, where a stretch has neither, at every `stride` tokens; cut j costs what it breaks (nothing, a
little, more), and a window from cut i to cut j also costs its padding. With positions p,

    best[j] = cost[j] + window - p[j] + min over i, p[j] - window <= p[i] < p[j], of best[i] + p[i]

and the minimum over the sliding range comes from a monotone queue. A window of exactly a power of
two needs no padding, so the last stretch of a range, which no later document can fill, is cut into
powers of two.

A range is one task's documents; its stream is cut in stretches of about `STRETCH` tokens, the last
window of each being carried into the next, so that memory is bounded. Sequence numbers are made
global by the sums of the ranges before.

Nulls: a null text is empty (its piece is the end id alone); a null doc_id sorts first; equal doc_ids
stay separate documents. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, narrow, parts, slices, table, written
from .token_files import NO_ID, in_order
from .tokens import SLICE, default_tokenizer, encoder

WINDOW, STRIDE, SENTENCE_COST, BREAK_COST, STRETCH = 4096, 64, 2, 24, 1 << 20
PIECES = "range int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local long, offset long"


def cut_costs(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(positions, costs) of all allowed cuts of n tokens, ascending, 0 and n included."""
    kind = np.zeros(n + 1, dtype=np.int8)
    kind[sentence_ends] = 1
    kind[doc_ends] = 2
    kind[[0, n]] = 2
    edges = np.flatnonzero(kind)
    # Stretches without a boundary: every stride tokens.
    count = np.maximum(0, (np.diff(edges) - 1) // stride)
    inner = np.repeat(edges[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1) * stride
    kind[inner] = 3
    at = np.flatnonzero(kind)
    return at, np.array([0, SENTENCE_COST, 0, BREAK_COST], dtype=np.int64)[kind[at]]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices of the chosen cuts, first and last included; at[i + 1] - at[i] <= window must hold."""
    p, c = at.tolist(), cost.tolist()
    n = len(p)
    best, back = [0] * n, [0] * n
    queue, values, head, tail = [0] * n, [0] * n, 0, 0  # the queue is queue[head:tail]
    for j in range(1, n):
        v = best[j - 1] + p[j - 1]
        while tail > head and values[tail - 1] >= v:
            tail -= 1
        values[tail], queue[tail] = v, j - 1
        tail += 1
        here = p[j]
        least = here - window
        while p[queue[head]] < least:
            head += 1
        best[j] = values[head] + window - here + c[j]
        back[j] = queue[head]
    # The last window costs nothing: it is cut into powers of two, or waits for the next stretch.
    reach = next(i for i in range(n) if p[n - 1] - p[i] <= window)
    back[-1] = min(range(reach, n - 1), key=best.__getitem__)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def powers(length: int, window: int = WINDOW) -> list[int]:
    """Lengths, powers of two, that sum to length."""
    out = [window] * (length // window)
    return out + [1 << b for b in range(window.bit_length() - 1, -1, -1) if (length % window) >> b & 1]


def sentence_ids(enc) -> np.ndarray:
    """Ids of tokens that end a sentence."""
    size = enc.whole.get_vocab_size(True)
    out = np.zeros(size, dtype=bool)
    for token, i in enc.whole.get_vocab(True).items():
        word = token.removesuffix("</w>").rstrip("\"')]}")
        out[i] = token.endswith("</w>") and word[-1:] in (".", "!", "?")
    return out


class Packer:
    """Takes documents one after the other and gives their pieces."""

    def __init__(self, ends: np.ndarray, window: int = WINDOW, stretch: int = STRETCH):
        self.ends, self.window, self.stretch = ends, window, stretch
        self.ids, self.docs, self.sequence = np.zeros(0, np.uint32), [], 0  # docs: (id, first token in it, rest tokens, all tokens)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        """Pieces that are settled now."""
        self.ids = np.concatenate((self.ids, ids))
        self.docs += [(d, 0, n, n) for d, n in zip(doc_ids.tolist(), counts.tolist(), strict=True)]
        if len(self.ids) >= self.stretch:
            yield from self.cut(False)

    def cut(self, last: bool):
        n = len(self.ids)
        if not n:
            return
        doc_ends = np.cumsum([d[2] for d in self.docs])
        boundary = self.ends[self.ids]
        at, cost = cut_costs(n, doc_ends, np.flatnonzero(boundary) + 1)
        chosen = at[best_cuts(at, cost, self.window)]
        lengths = np.diff(chosen).tolist()
        if last:
            padded = lengths.pop()
            lengths += powers(padded, self.window)
        else:
            lengths.pop()  # stays for the next stretch; n is over a window
        settled = self.pieces(lengths)
        yield from settled

    def pieces(self, lengths: list[int]):
        k, (doc, first, rest, all_) = 0, self.docs[0] if self.docs else (0, 0, 0, 0)
        done = 0
        for length in lengths:
            offset = 0
            while offset < length:
                take = min(rest, length - offset)
                yield doc, first, take, zlib.crc32(self.ids[done : done + take].astype("<u4").tobytes()), all_, self.sequence, offset
                done, offset, first, rest = done + take, offset + take, first + take, rest - take
                if not rest:
                    k += 1
                    if k < len(self.docs):
                        doc, first, rest, all_ = self.docs[k]
            self.sequence += 1
        self.docs = ([(doc, first, rest, all_)] if rest else []) + self.docs[k + 1 if rest else k :]
        self.ids = self.ids[done:]


def packed(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession

    def pack(batches):
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        packer = Packer(sentence_ids(enc), window)

        def batch_of(rows):
            doc, *rest = zip(*rows, strict=True)
            doc = np.array(doc, dtype=np.int64)
            names = ("start", "length", "ids_crc32", "doc_tokens", "local", "offset")
            return pa.RecordBatch.from_pydict({"range": pa.array(np.full(len(doc), part, np.int32)), "doc_id": pa.array(doc, mask=doc == NO_ID)} | {k: pa.array(v, pa.int64()) for k, v in zip(names, rest, strict=True)})

        for batch in slices(batches, "text", SLICE):
            ids, n = enc.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(n), end_id)
            names = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            if rows := list(packer.add(names, ids, n + 1)):
                yield batch_of(rows)
        if rows := list(packer.cut(True)):
            yield batch_of(rows)

    pieces = written(in_order(narrow(docs), parts(spark)).mapInArrow(lean(pack), PIECES), "pieces")
    # One row a range: bounded by the number of partitions.
    rows = sorted(pieces.groupBy("range").agg(F.max("local").alias("most")).collect())
    bases = np.cumsum([0, *[r["most"] + 1 for r in rows]]).tolist()
    base = spark.createDataFrame([(r["range"], b) for r, b in zip(rows, bases, strict=False)], "range int, base long")
    out = pieces.join(F.broadcast(base), "range")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"), "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packed(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=2)
