"""Numpy kernels of the suffix dedup: sampled suffix positions, multikey quicksort, covered bytes."""

from __future__ import annotations

import numpy as np

#: Length of the strings that must not repeat; bytes that an anchor is named by; strings that share an anchor.
LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], dtype=np.uint64)  # odd multipliers


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at every byte of data, most significant first, as integers."""
    return np.ndarray((max(0, len(data) - 7),), dtype=">u8", buffer=data, strides=(1,))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at every position that has them."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = w[:n] * MIX[0]
    h ^= h >> np.uint64(29)
    h += w[8 : n + 8] * MIX[1]
    h ^= h >> np.uint64(31)
    h += w[16 : n + 16]
    h *= MIX[2]
    h ^= h >> np.uint64(32)
    h *= MIX[3]
    return h


def _order(h: np.ndarray) -> np.ndarray:
    """The rank of hashes among anchors: their upper half, but never 0, which marks that there is no string."""
    return np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for every i that has as many."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in data, gram hash) of the anchors of texts that stand one after the other.

    In every LENGTH bytes of a text the gram of least hash is an anchor, so equal strings of LENGTH
    bytes share an anchor at the same place in them.
    """
    width = REACH + 1
    h = gram_hashes(data)
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    order = _order(h)
    least = _sliding(order, width, np.minimum)
    # Strings that run over the end of a text choose nothing.
    for end in offsets[1:-1].tolist():
        least[max(0, end - LENGTH + 1) : end] = 0
    most = _sliding(np.concatenate((np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32))), width, np.maximum)
    at = np.flatnonzero((most == order) & (most > 0))
    return at, h[at]


def named_strings(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings of one text that each anchor names: those where its hash is least."""
    n = len(text) - LENGTH + 1
    if n <= 0 or not len(at):
        return np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
    order = _order(gram_hashes(text))
    least = _sliding(order, REACH + 1, np.minimum)
    at = np.asarray(at, dtype=np.int64)
    starts = at[:, None] - REACH + np.arange(REACH + 1)
    inside = (starts >= 0) & (starts < n)
    own = inside & (least[np.clip(starts, 0, n - 1)] == order[np.minimum(at, len(order) - 1)][:, None]) & (at < len(order))[:, None]
    # A gram is least in consecutive strings: the first and the last say it all.
    low, high = at - REACH + own.argmax(axis=1), at - own[:, ::-1].argmax(axis=1)
    return np.where(own.any(axis=1), low, 1), np.where(own.any(axis=1), high, 0)


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of rows of bytes: their sorted order and, along it, a number that steps where the row changes.

    Multikey quicksort with characters of 8 bytes: rows are sorted by one character, and only runs
    that are still tied go on to the next.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8")
    order = np.argsort(keys[:, 0], kind="stable")
    first = keys[order, 0]
    step = np.zeros(n, dtype=bool)
    step[1:] = first[1:] != first[:-1]
    for c in range(1, keys.shape[1]):
        run = np.cumsum(step)
        tied = np.flatnonzero(np.bincount(run, minlength=1)[run] > 1) if n else np.zeros(0, np.int64)
        if not len(tied):
            break
        key, part = keys[order[tied], c].astype(np.uint64), run[tied]
        again = np.lexsort((key, part))
        order[tied] = order[tied][again]
        key = key[again]
        differs = np.zeros(len(tied), dtype=bool)
        differs[1:] = (key[1:] != key[:-1]) & (part[1:] == part[:-1])
        step[tied[differs]] = True
    return order, np.cumsum(step)


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [start, end) as maximal ones, ascending."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return s[new], e[last]
