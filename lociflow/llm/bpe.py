"""BPE encoding and decoding (10) by batched merge rounds in numpy.

The symbols of many words stand in one flat array. In each round every neighbouring pair of a word is
looked up by binary search among the sorted keys of all merges; each word merges its pair of lowest
rank wherever it stands, from the left, and words without a pair are done. Distinct words are merged
once a slice, and frequent ones are remembered by the worker.

Normalising and splitting follow the tokenizer file. Decoding joins the vocabulary's strings with one
space, which is what the library does for a file without a decoder.

Nulls: a null text is empty and has no ids; a null doc_id stays null. Repeated rows each get a row; an
empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, narrow, slices, table
from .tokens import SLICE, ChunkEncoder, default_tokenizer, encoder

NO_RANK = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it prints, else from 256 on in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    return [rest.get(b, chr(b)) for b in range(256)]


class MergeEncoder(ChunkEncoder):
    """Encodes pre-tokens by merge rounds; the library only normalises and splits odd chunks."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.vocab = spec["model"], dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = np.array([self.vocab[c] for c in alphabet], dtype=np.int64)
        self.final = np.array([self.vocab[c + suffix] for c in alphabet], dtype=np.int64)
        names = {i: t for t, i in (self.vocab | self.special).items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.size = len(self.names)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], dtype=np.int64)
        into = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), into[order]
        self.decoded: dict[bytes, bytes] = {}

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word of each symbol) after all merges; words are ascending numbers."""
        done_symbols, done_words = [], []
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(word)))
            best = np.repeat(least, lengths)
            live = best < NO_RANK
            done_symbols.append(symbols[~live])
            done_words.append(word[~live])
            hit = (rank == best) & live
            # In a run of overlapping pairs every second one merges, from the left.
            place = np.flatnonzero(hit)
            if len(place):
                new_run = np.concatenate(([True], np.diff(place) > 1))
                run_start = place[new_run][np.cumsum(new_run) - 1]
                place = place[(place - run_start) % 2 == 0]
            merged = symbols.copy()
            merged[place] = self.into[at[place]]
            keep = live
            keep[place + 1] = False
            symbols, word = merged[keep], word[keep]
        symbols, word = np.concatenate(done_symbols or [symbols]), np.concatenate(done_words or [word])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode_pretokens(self, words: list[str]) -> list[bytes]:
        data = [w.encode() for w in words]
        lengths = np.array([len(x) for x in data], dtype=np.int64)
        flat = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths)
        full = lengths > 0
        symbols[ends[full] - 1] = self.final[flat[ends[full] - 1]]
        ids, owner = self.merge(symbols, np.repeat(np.arange(len(words)), lengths))
        out = ids.astype("<u4").tobytes()
        edges = (np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words))))) * 4).tolist()
        return [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode_rest(self, chunks: list[str]) -> list[bytes]:
        out = []
        back = {c: b for b, c in enumerate(byte_alphabet())}
        for chunk in chunks:
            ids: list[bytes] = []
            while chunk:
                at, token = min(((chunk.find(t), t) for t in self.special if t in chunk), default=(len(chunk), ""))
                words = [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(chunk[:at]))] if at else []
                if words:
                    ids += self.encode_pretokens([bytes(back[c] for c in w).decode() for w in words])
                if token:
                    ids.append(np.array([self.special[token]], "<u4").tobytes())
                chunk = chunk[at + len(token) :]
            out.append(b"".join(ids))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8."""
        names = self.names
        return b" ".join([names[i] for i in ids.tolist()])


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    path = default_tokenizer()

    def both(batches):
        enc = encoder(path, MergeEncoder)
        for batch in slices(batches, "text", SLICE):
            ids, counts = enc.encode(batch.column("text"))
            n, ids_sha, text_sha = [], [], []
            for part in np.split(ids, np.cumsum(counts)[:-1]):
                n.append(len(part))
                ids_sha.append(hashlib.sha256(part.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(part)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    return narrow(table(spark, sf_dir, "documents")).mapInArrow(lean(both), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


