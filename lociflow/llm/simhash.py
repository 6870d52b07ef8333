"""SimHash near-dedup (4): fingerprints compared at the anchor points of a covering code.

A text's words, A-Z in lower case, make shingles; each fingerprint bit is 1 if set in over half of the
shingles' XXH64 values. Two fingerprints of 64 bits that differ in at most t bits agree up to one bit
in at least one of t // 2 + 1 blocks. Each block is covered by a code: a Hamming code of 2^r - 1 bits
(perfect, covering radius 1) times the block's other bits as they are. The code words are anchors.
Every fingerprint has one home anchor in each block, and is replicated to every anchor that is home to
some word within one bit of it, all of which lie within the covering radius plus the block's
threshold: so two near fingerprints meet at the home of either. Fingerprints are compared only at
anchors, and each anchor passes on a spanning forest of its links rather than all pairs.

Equal fingerprints are one class before anything is replicated, so groups of copies cost one entry.
The classes' components come from star contractions over the links.

Near groups (pipeline) also link texts by their sets of five-word shingles. No threshold of bits finds these: at a
similarity of 0.8 fingerprints differ in 10 bits of 64 on average and in 20 now and then, and anchors that cover 20
bits hold nearly every text. So alike sets meet, but for a chance of 5e-8 a pair, at a band key of their least hashes in
seeded orders (MinHash). Where they meet, parity maps tell at once most pairs that cannot be alike, and the others
are compared whole. Only texts of equal sets stand for one another there.

Nulls: a null text has no words and fingerprint zero, which links like any other; it has no shingles and links
to nothing by them. A null doc_id sorts before all others and shows as null. Rows that share a doc_id are one
document as far as links go; the pipeline's stage keeps all rows of a doc_id that stays. Ties fall to the smallest doc_id. An
empty table gives no rows; long texts are taken whole; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import discard, lean, narrow, parts, slices, table, written

WORDS, MOST_BITS, SEED = 3, 3, 42
NO_DOC = -(1 << 63)
#: Sets of Jaccard similarity j share no band key with a chance of (1 - j ** BAND_ROWS) ** BANDS: 5e-8 at 0.8.
BANDS, BAND_ROWS = 32, 4
#: One order of the hashes a row: odd multipliers and summands.
TIMES, PLUS = (np.array([[xxhash.xxh64_intdigest(b"%d" % i, seed) | 1] for i in range(BANDS * BAND_ROWS)], dtype=np.uint64) for seed in (1, 2))
#: Texts of a key that are compared with all others there, in the first round; so many times more in each later one, up to MOST_LEADERS.
LEADERS, MORE, MOST_LEADERS = 1, 64, 4096
#: Most numbers that are broadcast: 8 MB of them.
SMALL = 1_000_000
#: 64-bit words of a set's parity map.
MAP = [f"m{i}" for i in range(16)]
MARKS = "doc_id long, fp long, c long, n long, bands array<long>, " + ", ".join(f"{m} long" for m in MAP)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    w = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is \x20 \x09-\x0D
    h = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([h(b" ".join(w), SEED)] if w else [], dtype=np.uint64)
    return np.array([h(s, SEED) for s in map(b" ".join, zip(*(w[i:] for i in range(words))))], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    n = len(hashes)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 100_000):
        bits = np.unpackbits(hashes[at : at + 100_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def compute(batches):
        for batch in slices(batches, "text", 8 << 20):
            fp = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))})

    return narrow(docs).mapInArrow(lean(compute), "doc_id long, fp long")


class BlockCode:
    """The covering code of one block: a Hamming code on its low bits, the others as they are."""

    def __init__(self, width: int):
        self.width = width
        self.length = (1 << ((width + 1).bit_length() - 1)) - 1  # the longest Hamming code that fits
        if self.length > width:
            self.length >>= 1
        checks = self.length.bit_length()
        at = range(1, self.length + 1)  # bit i - 1 stands at position i
        self.masks = [np.uint64(sum(1 << (i - 1) for i in at if i >> j & 1)) for j in range(checks)]

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), dtype=np.int64)
        for j, m in enumerate(self.masks):
            s |= (np.bitwise_count(x & m).astype(np.int64) & 1) << j
        return s

    def anchors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, is home) of every anchor that is home to a word within one bit of x."""
        one, s = np.uint64(1), self.syndrome(x)
        flip = lambda i: np.where(i > 0, one << np.maximum(i - 1, 0).astype(np.uint64), np.uint64(0))
        home = x ^ flip(s)
        rows, out, is_home = [np.arange(len(x))], [home], [np.ones(len(x), bool)]
        for i in range(1, self.length + 1):
            pair = np.flatnonzero((s != 0) & (s != i) & (i < (s ^ i)))  # bits i and s ^ i lead to the same word
            rows.append(pair)
            out.append(x[pair] ^ flip(np.full(len(pair), i)) ^ flip(s[pair] ^ i))
        for b in range(self.length, self.width):
            rows.append(np.arange(len(x)))
            out.append(home ^ np.uint64(1 << b))
        is_home += [np.zeros(len(r), bool) for r in rows[1:]]
        return np.concatenate(rows), np.concatenate(out), np.concatenate(is_home)


def blocks_of(most_bits: int, in_block: int = 1) -> list[tuple[int, BlockCode]]:
    """(shift, code) of blocks such that any two words within most_bits agree up to in_block bits in one of them."""
    n = most_bits // (in_block + 1) + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, BlockCode(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def replicate(fp: np.ndarray, most_bits: int, in_block: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, block, anchor, is home) of all replicas of unsigned fingerprints."""
    out = []
    for k, (shift, code) in enumerate(blocks_of(most_bits, in_block)):
        mask = np.uint64((1 << code.width) - 1)
        rows, anchors, home = code.anchors((fp >> np.uint64(shift)) & mask)
        out.append((rows, np.full(len(rows), k, np.int8), anchors, home))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchor_links(fp: np.ndarray, node: np.ndarray, home: np.ndarray, ends: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links at each anchor; ends: where each anchor's rows end."""
    starts = np.concatenate(([0], ends[:-1]))
    homes = np.add.reduceat(home.astype(np.int64), starts) if len(starts) else starts
    a, b = [], []
    for g in np.flatnonzero((ends - starts > 1) & (homes > 0)):
        f, n = fp[starts[g] : ends[g]], node[starts[g] : ends[g]]
        label = np.arange(len(f))
        for i in np.flatnonzero(home[starts[g] : ends[g]]).tolist():
            near = np.flatnonzero(np.bitwise_count(f ^ f[i]) <= most_bits)
            other = near[label[near] != label[i]]
            if not len(other):
                continue
            labels, first = np.unique(label[other], return_index=True)
            a.append(np.full(len(first), n[i]))
            b.append(n[other[first]])
            label[np.isin(label, labels)] = label[i]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def whole_groups(batches, columns: list[str], keys: int):
    """(the columns' arrays, where each group ends), by whole groups of rows that come sorted by the first keys columns."""
    held: list[list[np.ndarray]] = []  # of the group that is still open, batch by batch
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in columns]
        differs = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in now[:keys]])) + 1
        goes_on = bool(held) and all(x[0] == y[-1] for x, y in zip(now[:keys], held[-1][:keys], strict=True))
        cuts = differs if goes_on or not held else np.concatenate(([0], differs))
        if not len(cuts):
            held.append(now)
            continue
        k = cuts[-1]
        done = [np.concatenate(x) for x in zip(*held, [x[:k] for x in now], strict=True)]
        yield done, cuts + (len(done[0]) - k)
        held = [[x[k:] for x in now]]
    if held:
        done = [np.concatenate(x) for x in zip(*held, strict=True)]
        yield done, np.array([len(done[0])])


def links(classes: DataFrame, most_bits: int) -> DataFrame:
    """(a, b): links between classes (fp, node) that differ in at most most_bits bits; enough to connect all that are linked."""

    def emit(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 4096):
                rows, block, anchor, home = replicate(fp[at : at + 4096].view(np.uint64), most_bits)
                yield pa.RecordBatch.from_pydict({"block": pa.array(block), "anchor": pa.array(anchor.view(np.int64)), "home": pa.array(home), "fp": pa.array(fp[at : at + 4096][rows]), "node": pa.array(node[at : at + 4096][rows])})

    def compare(batches):
        for (_, _, home, fp, node), ends in whole_groups(batches, ["block", "anchor", "home", "fp", "node"], 2):
            a, b = anchor_links(fp.view(np.uint64), node, home, ends, most_bits)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    replicas = classes.mapInArrow(lean(emit), "block byte, anchor long, home boolean, fp long, node long")
    met = replicas.repartition(parts(classes.sparkSession), "block", "anchor").sortWithinPartitions("block", "anchor")
    return met.mapInArrow(lean(compare), "a long, b long").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def named_fingerprints(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(fp, component) of every fingerprint of (doc_id, fp); a component of null documents is NO_DOC."""
    classes = written(fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_DOC))).alias("node")), "classes")
    found = connected_components(links(classes, most_bits))
    return classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))


def components(docs: DataFrame, words: int = WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component) of every document."""
    fps = written(fingerprints(docs, words), "fingerprints")
    out = fps.join(named_fingerprints(fps, most_bits), "fp")
    return out.select("doc_id", "fp", F.when(F.col("component") != NO_DOC, F.col("component")).alias("component"))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set: each of BAND_ROWS least values, by as many orders of the hashes."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048] * TIMES + PLUS).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * TIMES[0]
        keys ^= keys >> np.uint64(32)
    return keys


def set_class(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles, ascending."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """One bit for each remainder of the hashes: whether an odd number of them has it.

    Each hash that only one of two sets holds changes one bit, so maps differ in no more bits than sets in hashes.
    """
    odd = np.bincount((hashes % np.uint64(64 * len(MAP))).astype(np.int64), minlength=64 * len(MAP)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, c, n, bands, MAP) of every text: its fingerprint, and the class, size, band keys and parity map of its set of shingles, if it has any."""

    def compute(batches):
        for batch in slices(batches, "text", 8 << 20):
            fp, c, n, bands, maps = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                s = np.unique(shingle_hashes(t, words))
                fp.append(fingerprint(shingle_hashes(t, WORDS)))
                c.append(set_class(s) if len(s) else None)
                n.append(len(s))
                bands.append(band_keys(s).view(np.int64) if len(s) else None)
                maps.append(parity_map(s))
            maps = np.array(maps).T
            out = {"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), "c": pa.array(c, pa.int64()), "n": pa.array(n, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(out | {m: pa.array(np.ascontiguousarray(x)) for m, x in zip(MAP, maps, strict=True)})

    return narrow(docs).mapInArrow(lean(compute), MARKS)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(c, s): class and distinct shingle hashes of every text, ascending as unsigned numbers."""

    def compute(batches):
        for batch in slices(batches, "text", 8 << 20):
            s = [np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"c": pa.array([set_class(x) for x in s], pa.int64()), "s": pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64()))})

    return narrow(docs).mapInArrow(lean(compute), "c long, s array<long>")


def alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of (a, b, sa, sb) whose shingle sets have at least that Jaccard similarity."""

    def lists(column: pa.ListArray) -> list[np.ndarray]:
        flat, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
        return [flat[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]

    def verify(batches):
        for batch in batches:
            good = []
            for x, y in zip(lists(batch.column("sa")), lists(batch.column("sb")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(lean(verify), "a long, b long")


def meetings(classes: DataFrame) -> DataFrame:
    """(key, node, c, n, MAP) of the classes (c, node, n, MAP, bands) at every band key that two nodes share.

    Keys are met by names alone; only the rows that stay get their maps.
    """
    met = shared(classes.select(F.explode("bands").alias("key"), "node", "c"))
    return met.join(classes.select("c", "n", *MAP), "c")


def shared(met: DataFrame) -> DataFrame:
    """The rows of met at keys that hold two nodes at least."""
    keys = met.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key")
    return met.join(keys, "key", "left_semi")


def led(met: DataFrame, leaders: int) -> DataFrame:
    """The rows of up to `leaders` texts of each key, the least of each salt; their columns get l_."""
    salt = F.pmod(F.xxhash64("c", "key"), F.lit(leaders)).alias("salt")
    first = met.groupBy("key", salt).agg(F.min(F.struct(*[F.col(x).alias(f"l_{x}") for x in ("c", "node", "n", *MAP)])).alias("first"))
    return first.select(F.col("key").alias("l_key"), "first.*")


def candidates(met: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ca, cb): nodes and classes of every leader and every text of another node at its key.

    Left out are pairs whose parity maps differ in more bits than the sets of a pair that is alike can in hashes.
    """
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"l_{m}"))) for m in MAP[1:]), F.bit_count(F.col(MAP[0]).bitwiseXOR(F.col(f"l_{MAP[0]}"))))
    may = apart * (1 + similarity) <= (F.col("n") + F.col("l_n")) * (1 - similarity) + 1e-6
    pairs = met.join(leaders, (F.col("key") == F.col("l_key")) & (F.col("node") != F.col("l_node")) & may)
    return pairs.select(F.col("l_node").alias("a"), F.col("node").alias("b"), F.col("l_c").alias("ca"), F.col("c").alias("cb")).distinct()


def relabelled(df: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """df with the nodes in a column replaced by their components."""
    to = found.select(F.col("node").alias("_node"), F.col("component").alias("_to"))
    return df.join(to, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")


def if_small(keys: DataFrame) -> DataFrame:
    """A written table of one column of numbers, broadcast if it has no more than SMALL rows; else it is shuffled."""
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group) of every document: near copies of at least that similarity share the smallest doc_id.

    Fingerprints within MOST_BITS are one group. Texts of different groups meet at band keys and are linked if
    their shingle sets are alike. In each round a key's leaders are compared with its texts of other groups, and
    have then done; what they link becomes one group, which has no more to compare within. Rounds go on until
    no key holds two groups: no pair is left out, and a group of near copies costs about its size.
    """
    marks = written(signatures(docs, words), "signatures")
    known = F.coalesce("doc_id", F.lit(NO_DOC))
    named = written(named_fingerprints(marks.select("doc_id", "fp")), "tight")
    some = marks.filter("c is not null")
    texts = written(some.groupBy("fp", "c").agg(F.min(known).alias("doc")).join(named, "fp").drop("fp"), "texts")
    wide = some.groupBy("c").agg(*[F.min(x).alias(x) for x in ("n", "bands", *MAP)])  # the same in all texts of a class
    classes = written(texts.groupBy("c").agg(F.min("component").alias("node"), F.min("doc").alias("doc")).join(wide, "c"), "text_classes")
    good = texts.join(classes.select("c", "node"), "c").filter("component <> node").select(F.col("component").alias("a"), F.col("node").alias("b"))
    met = written(meetings(classes), "meetings")
    asked = written(classes.join(met.select("c").distinct(), "c", "left_semi").select(F.col("doc").alias("doc_id")).distinct(), "asked")
    base = narrow(docs).select(known.alias("doc_id"), "text").join(if_small(asked), "doc_id", "left_semi")
    sets = written(shingle_sets(base, words).groupBy("c").agg(F.min("s").alias("s")), "shingles")
    leaders, links_found = LEADERS, [written(good, "alike")]
    while not met.isEmpty():
        lead = written(led(met, leaders), "leaders")
        pairs = written(candidates(met, lead, similarity), "pairs")
        members = written(pairs.select(F.col("ca").alias("c")).union(pairs.select("cb")).distinct(), "members")
        theirs = written(sets.join(if_small(members), "c", "left_semi"), "compared")
        put = pairs.join(theirs.select(F.col("c").alias("ca"), F.col("s").alias("sa")), "ca").join(theirs.select(F.col("c").alias("cb"), F.col("s").alias("sb")), "cb")
        found = written(alike(put.select("a", "b", "sa", "sb"), similarity).distinct(), "alike")
        links_found.append(found)
        left = met.join(lead.select(F.col("l_key").alias("key"), F.col("l_c").alias("c")), ["key", "c"], "left_anti")
        if not found.isEmpty():
            left = relabelled(left, "node", connected_components(found))
        before, met = met, written(shared(left.select(met.columns)), "meetings")
        discard(before, lead, pairs, members, theirs)
        leaders = min(leaders * MORE, MOST_LEADERS)
    discard(met, sets, classes, texts, asked)
    good = reduce(DataFrame.unionByName, links_found)
    return marks.join(relabelled(named, "component", connected_components(good)), "fp").select(known.alias("doc_id"), F.col("component").alias("group"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their group of near copies; all columns stay."""
    keep = near_groups(docs).filter("doc_id = group").select(F.col("doc_id").alias("keep")).distinct()
    return docs.join(keep, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_DOC)) == keep["keep"], "left_semi")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
