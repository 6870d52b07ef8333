"""Token counts (5): unigram segmentation by dynamic programming shared along a trie.

The vocabulary is a sentencepiece file's pieces; piece number r, of all that are not control or byte
pieces, has the score -log(r + RANK_SHIFT) of a Zipfian unigram model (a documented parameter; nothing
is trained). A text's pre-tokens are its runs between ASCII white space, each with the word mark in
front. A pre-token's count is the number of pieces of its segmentation of highest total score; a
character that no piece covers is one piece at the score UNKNOWN. Ties go to fewer pieces.

Distinct pre-tokens of a slice are put in a trie, level by level: a node is a distinct prefix. The
forward score of a node is the best over its ancestors within the longest piece's length of their
score plus the piece that leads here, computed once for all pre-tokens that share the prefix. Piece
lookups are binary searches over sorted hashes of piece texts. The counts at terminal nodes are kept.

Nulls: a null text is empty and has no tokens; a null doc_id stays null. Repeated rows each get a row;
an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import lean, narrow, slices, table

MARK, RANK_SHIFT, UNKNOWN = "▁", 10.0, -20.0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> dict[str, float]:
    """Piece texts and their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -math.log(r + RANK_SHIFT) for r, p in enumerate(names)}


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    return flat, np.array([len(w) for w in words], dtype=np.int64)


class PieceTrie:
    """Counts the pieces of many distinct words."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        flat, lengths = _code_points(list(pieces))
        self.longest = int(lengths.max(initial=1))
        hashes = np.zeros(len(lengths), dtype=np.uint64)
        starts = np.cumsum(lengths) - lengths
        for k in range(self.longest):
            has = lengths > k
            hashes[has] = self.extend(hashes[has], flat[starts[has] + k])
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array(list(pieces.values()), dtype=np.float64)[order]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")

    @staticmethod
    def extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h + code.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        return h ^ (h >> np.uint64(29))

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of pieces of each of the distinct words."""
        flat, lengths = _code_points(words)
        n = len(words)
        out = np.zeros(n, dtype=np.int64)
        if not n:
            return out
        starts = np.cumsum(lengths) - lengths
        node = np.zeros(n, dtype=np.int64)  # the node of each word at the present depth; the root is 0
        # By depth, counted back from the present one: of each node its forward score, its count and, for the
        # text from there to here, the hash.
        history: list[list[np.ndarray]] = [[np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.uint64)]]
        out[lengths == 0] = 0
        live = np.flatnonzero(lengths > 0)
        node = node[live]
        for depth in range(int(lengths.max(initial=0))):
            code = flat[starts[live] + depth].astype(np.int64)
            # Children of this level: distinct (parent, character).
            child, first, node = np.unique(node << 32 | code, return_index=True, return_inverse=True)
            parent, char = child >> 32, (child & 0xFFFFFFFF).astype(np.uint64)
            best = np.full(len(child), -np.inf)
            count = np.zeros(len(child), dtype=np.int64)
            nearer = []
            for back, (score, pieces, h) in enumerate(history):
                h = self.extend(h[parent], char)
                score, pieces = score[parent], pieces[parent]
                nearer.append([score, pieces, h])
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                found = self.hashes[at] == h
                with_piece = score + np.where(found, self.scores[at], UNKNOWN if back == 0 else -np.inf)
                better = (with_piece > best) | ((with_piece == best) & (pieces + 1 < count))
                best, count = np.where(better, with_piece, best), np.where(better, pieces + 1, count)
            history = [[best, count, np.zeros(len(child), np.uint64)], *nearer][: self.longest]
            ended = lengths[live] == depth + 1
            out[live[ended]] = count[node[ended]]
            live, node = live[~ended], node[~ended]
        return out


def token_counts(docs: DataFrame, pieces_path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every document."""

    def count(batches):
        trie = PieceTrie(read_pieces(pieces_path))
        for batch in slices(batches, "text", 6 << 20):
            lists = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), "").cast(pa.large_string()))
            flat = lists.flatten().dictionary_encode()
            distinct = flat.dictionary.to_pylist()
            each = trie.counts([MARK + w if w else "" for w in distinct])
            used = np.array([bool(w) for w in distinct], dtype=np.int64)
            codes = flat.indices.to_numpy()
            per_text = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v[codes])))[per_text])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_pretokens": pa.array(total(used)), "n_tokens": pa.array(total(each))})

    return narrow(docs).mapInArrow(lean(count), "doc_id long, n_pretokens long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"), default_pieces())
