"""Token ids of many texts with the tokenizers library, each distinct pre-token encoded once.

A text's ids are those of its pre-tokens, one after the other. Plain texts are lower-cased and split
in one pass over a whole slice; texts with special tokens or less common characters are cut at white
space, which always ends a pre-token, and their odd chunks go through the library as they are.
"""

from __future__ import annotations

import os
import re
import struct
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import spread

#: The pre-token pattern of word_bpe_49k.json is 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+
#: Here for lower-case plain texts, whose letters and numbers are these.
LETTERS, NUMBERS = "a-zªµºß-öø-ʯ", "0-9²³¹¼-¾"
PRETOKEN = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: A character that isn't plain; U+023A and U+023E are not, as their lower case lies outside of LETTERS.
ODD = re.compile(r"[^\t\n\r -~¡-¬®-\u0239\u023b-\u023d\u023f-ʯ]")
#: Pre-tokens that a worker remembers; beyond it starts anew.
CACHE = 500_000
ASCII_SPACE = re.compile(r"[ \t-\r]+")
#: Bytes of text encoded at once: its pre-tokens are so many strings of a worker.
SLICE = 2 << 20

_encoders: dict[str, "ChunkEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, kind=None) -> "ChunkEncoder":
    """The worker's encoder for a tokenizer file; kept while the worker lives."""
    kind = kind or ChunkEncoder
    key = f"{kind.__name__}:{path}"
    if key not in _encoders:
        _encoders[key] = kind(path)
    return _encoders[key]


class Codes(dict):
    """Numbers of pre-tokens in the order in which they are first asked for; new ones are noted in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n


class ChunkEncoder:
    """Encodes text columns into one flat array of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        # The file's own steps, and those for pre-tokens that are already lower case and split: one model serves both.
        self.own = self.whole.normalizer, self.whole.pre_tokenizer
        self.bare = normalizers.Sequence([]), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.forget()

    def forget(self) -> None:
        """Start with no known pre-token but NUL, which stands between texts and has no ids."""
        self.codes = Codes()
        self.codes["\0"] = 0
        self.lengths, self.starts, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    @contextmanager
    def steps(self, steps: tuple):
        """Within it, the library normalises and splits by these steps."""
        self.whole.normalizer, self.whole.pre_tokenizer = steps
        try:
            yield
        finally:
            self.whole.normalizer, self.whole.pre_tokenizer = self.own

    def encode_pretokens(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        tokenize, pack = self.whole.model.tokenize, struct.pack
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            if all(map(str.isascii, part)):
                # Printable ASCII stands for itself in the byte-level alphabet.
                out += [pack(f"<{len(x)}I", *[t.id for t in x]) for x in map(tokenize, part)]
                continue
            with self.steps(self.bare):
                e = self.whole.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            counts = np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(part)) if len(ids) else np.zeros(len(part), np.int64)
            ends = (np.cumsum(counts) * 4).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def encode_rest(self, chunks: list[str]) -> list[bytes]:
        """Chunks with special tokens or less common characters: the library does all of it."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.whole.encode_batch(chunks, add_special_tokens=False)]

    def learn(self) -> None:
        """Encode the pre-tokens that were asked for since the last call; their ids go to the end of the pool."""
        fresh, self.codes.fresh = self.codes.fresh, []
        if not fresh:
            return
        # Encoded with those alike, remembered in the order of their numbers.
        by_kind = sorted(range(len(fresh)), key=lambda i: fresh[i].isascii())
        data: list[bytes] = [b""] * len(fresh)
        for i, ids in zip(by_kind, self.encode_pretokens([fresh[i] for i in by_kind]), strict=True):
            data[i] = ids
        lengths = np.fromiter(map(len, data), np.int64, len(data)) >> 2
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.pool = np.concatenate((self.pool, np.frombuffer(b"".join(data), dtype="<u4")))

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of plain texts, which hold no NUL."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.codes) > CACHE:
            self.forget()
        found = PRETOKEN.findall("\n\0\n".join(texts).lower())
        codes = np.fromiter(map(self.codes.__getitem__, found), np.int32, len(found))
        del found
        self.learn()
        each = self.lengths[codes]
        ids = self.pool[spread(self.starts[codes], each)]
        ends = np.append(np.flatnonzero(codes == 0), len(codes))
        total = np.concatenate(([0], np.cumsum(each)))[ends]
        return ids, np.diff(total, prepend=0)

    def encode_odd(self, texts: list[str]) -> list[np.ndarray]:
        """Texts with special tokens or less common characters, by chunks between ASCII white space."""
        split = [ASCII_SPACE.split(t) for t in texts]
        distinct = list(dict.fromkeys(c for t in split for c in t if c))
        plain = [c for c in distinct if self.is_plain(c)]
        ids, counts = self.encode_plain(plain)
        data = dict(zip(plain, np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if plain else {}
        rest = [c for c in distinct if c not in data]
        data.update(zip(rest, (np.frombuffer(x, "<u4") for x in self.encode_rest(rest)), strict=True))
        return [np.concatenate([data[c] for c in t if c] or [np.zeros(0, "<u4")]) for t in split]

    def is_plain(self, text: str) -> bool:
        return "\0" not in text and "<|" not in text and ODD.search(text) is None

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, number of ids of each text)."""
        texts = pc.fill_null(column, "").to_pylist()
        plain = [self.is_plain(t) for t in texts]
        ids, counts = self.encode_plain([t for t, p in zip(texts, plain, strict=True) if p])
        if all(plain):
            return ids, counts
        odd = iter(self.encode_odd([t for t, p in zip(texts, plain, strict=True) if not p]))
        even = iter(np.split(ids, np.cumsum(counts)[:-1])) if len(counts) else iter(())
        each = [next(even) if p else next(odd) for p in plain]
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
