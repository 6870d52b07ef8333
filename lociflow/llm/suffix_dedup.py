"""Suffix-array dedup (3): bytes covered by a string of 50 bytes that starts in an earlier document too.

1. Suffixes are sampled by content: in every 50 bytes the 24-byte gram of least hash starts an anchor
   suffix, so equal 50-byte strings hold the same anchor at the same place. Anchors are dealt by hash;
   only those whose gram occurs in different texts go on (about one in seven here). Shuffling every
   suffix of the corpus would move some fifty times the input.
2. The suffixes of those anchors, with the bytes before them that a 50-byte string around the gram may
   hold, are range-partitioned by their leading bytes, between splitters sampled from the repeated
   grams. A bucket sorts its suffixes by multikey quicksort. Splitters are whole grams, so equal strings never lie on
   both sides of a boundary. Equal neighbours share their least document; where
   neighbours share only the gram, each 50-byte string that holds it is sorted and compared likewise.
3. The covered bytes come back to their document and are cut out.

Equal suffixes of one task are sent once with the list of their places. A gram with more than `HOT` different
texts is not gathered in one bucket: its 50-byte strings are sent on their own, dealt by hash.

Copies of whole texts are found by hash first; only the smallest doc_id of each text takes part.

Nulls: a null text is empty; a null doc_id counts as smaller than any other. Rows that share a doc_id
are different documents, none smaller than the other. Texts under 50 bytes keep everything; very long texts
are taken whole. Of documents that hold a string the smallest doc_id keeps it, all rows that share that
doc_id. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, discard, lean, narrow, parts, release, slices, spread, table, texts, written
from .suffix_kernel import GRAM, LENGTH, REACH, anchors, covered, multikey_sort, named_strings

HOT, BLOCK, SAMPLE_BAND, SAMPLE_EACH = 20_000, 900_000, 256, 32
#: Contexts held before a task sends them; contexts whose strings are compared at once.
CONTEXTS, COMPARED = 150_000, 6_000
#: Buckets of anchors for each shuffle partition: every anchor of the corpus passes through them.
FINER = 3
NO_DOC = -(1 << 63)
CONTEXT = REACH + LENGTH
#: The order in which a context's bytes are sorted: the suffix itself, then what stands before it.
SORTED = np.concatenate((np.arange(REACH, CONTEXT), np.arange(REACH - 1, -1, -1)))
MESSAGE = "to int, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message; bytes of like weight stand together."""
    head = ";".join(f"{a.dtype.str},{','.join(map(str, a.shape))}" for a in arrays).encode()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(a.shape[0], -1).T if a.ndim == 1 and len(a) else a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(4, "little") + head + b"".join(planes))


def unpack(message: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(message)
    n = int.from_bytes(data[:4], "little")
    at, out = 4 + n, []
    for kind, *shape in (x.split(",") for x in data[4 : 4 + n].decode().split(";")):
        shape, kind = tuple(map(int, shape)), np.dtype(kind)
        size = int(np.prod(shape)) * kind.itemsize
        raw = np.frombuffer(data, np.uint8, size, at)
        at += size
        if len(shape) == 1 and size:
            raw = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T)
        out.append(raw.view(kind).reshape(shape))
    return out


def messages(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    to, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"to": pa.array(to, pa.int32()), "payload": pa.array(payload, pa.binary())})


def dealt(to: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """(order, [(number, its slice of the order)]) of rows dealt to 0 .. n - 1."""
    order = np.argsort(to, kind="stable")
    ends = np.cumsum(np.bincount(to, minlength=n))
    return order, [(k, slice(int(a), int(b))) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a]


def text_class(data: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(data)


def shard(doc: np.ndarray, n: int) -> np.ndarray:
    return ((doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def anchor_messages(docs: DataFrame, n: int) -> DataFrame:
    """The anchors of all texts, dealt to n buckets by gram hash: hash, document, text class, position, and a sample of grams."""

    limits = np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)

    def emit(batches):
        held: list[tuple] = []
        count = texts_held = 0

        def flush():
            h, index, pos, sample_h, sample, names, classes = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, index, pos = h[order], index[order], pos[order]
            edges = [0, *np.searchsorted(h, limits).tolist(), len(h)]
            s_order = np.argsort(sample_h)
            sample_h, sample = sample_h[s_order], sample[s_order]
            s_edges = [0, *np.searchsorted(sample_h, limits).tolist(), len(sample_h)]
            rows = []
            for k in range(n):
                a, b = edges[k], edges[k + 1]
                if a < b:
                    # 48 bits of the hash tell grams of a bucket apart; a chance meeting only costs a look.
                    key = h[a:b] >> np.uint64(16)
                    sa, sb = s_edges[k], s_edges[k + 1]
                    here, own = np.unique(index[a:b], return_inverse=True)  # the texts that this bucket sees
                    rows.append((k, pack(np.diff(key, prepend=key[:1]), key[:1], own.astype(np.uint32), pos[a:b], names[here], classes[here] >> np.uint64(8), sample_h[sa:sb] >> np.uint64(16), sample[sa:sb])))
            return messages(rows)

        for batch in slices(batches, "text", 2 << 20):
            data, offsets = texts(batch.column("text"))
            at, h = anchors(data, offsets)
            if not len(at):
                continue
            row = np.searchsorted(offsets, at, side="right") - 1
            names = batch.column("doc_id").to_numpy(zero_copy_only=False)
            classes = np.array([text_class(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=np.uint64)
            band = np.flatnonzero((h >> np.uint64(16)) % np.uint64(SAMPLE_BAND) == 0)
            held.append((h, (row + texts_held).astype(np.uint32), (at - offsets[row]).astype(np.uint32), h[band], data[at[band][:, None] + np.arange(GRAM)], names, classes))
            count += len(at)
            texts_held += len(names)
            if count >= BLOCK:
                yield flush()
                held, count, texts_held = [], 0, 0
                release()
        if held:
            yield flush()

    return docs.mapInArrow(lean(emit), MESSAGE)


def repeated_places(received: DataFrame, n: int) -> DataFrame:
    """Per bucket: (document, position, hot) of anchors whose gram occurs in different texts, sent to the documents' shards; sampled grams go to shard -1."""

    def find(batches):
        got = [unpack(p) for b in batches for p in b.column("payload").to_pylist()]
        if not got:
            return
        key = np.concatenate([np.cumsum(g[0]) + g[1] for g in got])
        doc = np.concatenate([g[4][g[2]] for g in got])
        cls = np.concatenate([g[5][g[2]] for g in got])
        pos = np.concatenate([g[3] for g in got])
        sample_key, sample = np.concatenate([g[6] for g in got]), np.concatenate([g[7] for g in got])
        del got
        order = np.lexsort((doc, cls, key))
        key, doc, cls, pos = key[order], doc[order], cls[order], pos[order]
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_text = new_key | np.concatenate(([True], cls[1:] != cls[:-1]))
        gram = np.cumsum(new_key) - 1
        n_texts = np.bincount(gram, weights=new_text)
        # Of the copies of a text only the first document stays.
        first = doc[np.flatnonzero(new_text)][np.cumsum(new_text) - 1]
        stays = (n_texts[gram] > 1) & (doc == first)
        kept, pos, hot = doc[stays], pos[stays], (n_texts[gram] > HOT)[stays]
        if len(kept):
            order, runs = dealt(shard(kept, n), n)
            yield messages([(k, pack(kept[order[s]], pos[order[s]], hot[order[s]])) for k, s in runs])
        repeated = key[new_key][n_texts > 1]
        sample = np.unique(sample[np.isin(sample_key, repeated)], axis=0)
        if len(sample):
            sample = sample[:: -(-len(sample) // SAMPLE_EACH)]
            yield messages([(-1, sample.tobytes())])

    return received.mapInArrow(lean(find), MESSAGE)


def per_document(received: DataFrame, names: list[str], schema: str) -> DataFrame:
    """One row a document from messages of (document, column, ...): its values as lists, ordered by the first."""

    def gather(batches):
        got = [unpack(p) for b in batches for p in b.column("payload").to_pylist()]
        if not got:
            return
        columns = [np.concatenate(x) for x in zip(*got, strict=True)]
        doc = columns[0]
        order = np.lexsort((columns[1], doc))
        columns = [c[order] if c.dtype == bool else c[order].astype(np.int64) for c in columns]
        doc = columns[0]
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        edges = np.append(starts, len(doc)).astype(np.int32)
        for at in range(0, len(starts), 5000):
            e = edges[at : at + 5001]
            lists = [pa.ListArray.from_arrays(pa.array(e - e[0]), pa.array(c[e[0] : e[-1]])) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(doc[e[:-1]]), *lists], names=names)

    return received.mapInArrow(lean(gather), schema)


def compressed(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, blob) of all texts of at least LENGTH bytes."""

    def squeeze(batches):
        c = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", 4 << 20):
            data, offsets = texts(batch.column("text"))
            bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            cls = np.array([text_class(data[a:b]) & 0xFFFFFFFF for a, b in bounds], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "cls": pa.array(cls), "blob": pa.array([c.compress(data[a:b]) for a, b in bounds], pa.binary())})

    return docs.mapInArrow(lean(squeeze), "doc_id long, cls long, blob binary")


def contexts(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows) of the contexts of anchors at the given positions.

    A row: the suffix from the anchor on, the bytes before it backwards, and the first and last of the
    strings in whose grams the anchor's has the least hash; bytes outside of those strings are zero.
    The last byte marks strings of hot grams, which travel on their own.
    """
    low, high = named_strings(text, at)
    ok = low <= high
    at, low, high = at[ok], low[ok], high[ok]
    wide = np.concatenate((np.zeros(REACH, np.uint8), text, np.zeros(LENGTH, np.uint8)))
    rows = np.zeros((len(at), CONTEXT + 3), dtype=np.uint8)
    rows[:, :CONTEXT] = wide[at[:, None] + SORTED]
    rows[:, CONTEXT], rows[:, CONTEXT + 1] = low - at + REACH, high - at + REACH
    # Bytes of strings that other anchors name stay away.
    rows[:, :CONTEXT][(SORTED < rows[:, CONTEXT, None]) | (SORTED >= rows[:, CONTEXT + 1, None].astype(np.int64) + LENGTH)] = 0
    return at, rows


def strings_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, context that has only one 50-byte string) for every string of every context."""
    low, high = rows[:, CONTEXT].astype(np.int64), rows[:, CONTEXT + 1].astype(np.int64)
    count = high - low + 1
    which = np.repeat(np.arange(len(rows)), count)
    first = spread(low, count)
    out = np.zeros((len(which), CONTEXT + 3), dtype=np.uint8)
    out[:, CONTEXT] = out[:, CONTEXT + 1] = first
    # The string from REACH - first bytes before the anchor on: zero what it doesn't hold.
    column = SORTED[None, :]
    holds = (column >= first[:, None]) & (column < first[:, None] + LENGTH)
    out[:, :CONTEXT] = np.where(holds, rows[which, :CONTEXT], 0)
    return which, out


def grams_of(rows: np.ndarray) -> np.ndarray:
    """The grams as three big-endian integers, comparable as records."""
    return np.ascontiguousarray(rows[:, :GRAM]).view([("a", ">u8"), ("b", ">u8"), ("c", ">u8")]).reshape(-1)


def bucket_of(rows: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The range of each row's gram between the splitters (m, GRAM)."""
    if not len(splitters):
        return np.zeros(len(rows), np.int64)
    both = np.concatenate((splitters, np.ascontiguousarray(rows[:, :GRAM])))
    order, group = multikey_sort(both)
    rank = np.empty(len(both), np.int64)
    rank[order] = group
    return np.searchsorted(rank[: len(splitters)], rank[len(splitters) :], side="right")


def context_messages(found: DataFrame, splitters: np.ndarray, n: int) -> DataFrame:
    """The contexts of the repeated anchors, equal ones of a task once, dealt by gram."""

    def emit(batches):
        held: list[tuple] = []
        size = 0
        expand = zstandard.ZstdDecompressor()

        def flush():
            rows, doc, cls, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order, group = multikey_sort(rows)
            rows, doc, cls, pos = rows[order], doc[order], cls[order], pos[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            count = np.diff(np.append(first, len(rows))).astype(np.uint32)
            rows = rows[first]
            to = bucket_of(rows, splitters)
            alone = rows[:, CONTEXT + 2] == 1
            if alone.any():  # strings on their own are dealt by hash
                to[alone] = [xxhash.xxh3_64_intdigest(r.tobytes()) % n for r in rows[alone]]
            order, runs = dealt(to, n)
            out = []
            for k, s in runs:
                own = order[s]
                members = spread(first[own], count[own].astype(np.int64))
                out.append((k, pack(rows[own], count[own], doc[members], cls[members], pos[members])))
            return messages(out)

        for batch in batches:
            for doc, cls, blob, at, hot in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "cls", "blob", "at", "hot")), strict=True):
                text = np.frombuffer(expand.decompress(blob), np.uint8)
                at, hot = np.array(at, np.int64), np.array(hot, bool)
                pos, rows = contexts(text, at[~hot])
                pos, rows = [pos], [rows]
                if hot.any():
                    p, r = contexts(text, at[hot])
                    which, strings = strings_of(r)
                    strings[:, CONTEXT + 2] = 1
                    pos.append(p[which])
                    rows.append(strings)
                pos, rows = np.concatenate(pos), np.concatenate(rows)
                held.append((rows, np.full(len(pos), doc, np.int64), np.full(len(pos), cls, np.uint32), pos.astype(np.uint32)))
                size += len(pos)
                if size >= CONTEXTS:
                    yield flush()
                    held, size = [], 0
                    release()
        if size:
            yield flush()

    return found.mapInArrow(lean(emit), MESSAGE)


def group_least(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value of each of the ascending groups."""
    return np.minimum.reduceat(value, np.flatnonzero(np.diff(group, prepend=-1))) if len(group) else value


def removals(received: DataFrame, n: int) -> DataFrame:
    """Messages of (document, start, end, cls) to the documents' shards: bytes that an earlier document has."""

    def compare(batches):
        got = [unpack(p) for b in batches for p in b.column("payload").to_pylist()]
        if not got:
            return
        rows, count, doc, cls, pos = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        member_of = np.repeat(np.arange(len(rows)), count.astype(np.int64))
        order, group = multikey_sort(rows)
        context = np.empty(len(rows), np.int64)
        context[order] = group
        rows = rows[order[np.flatnonzero(np.diff(group, prepend=-1))]]  # one of each, ascending
        context = context[member_of]
        by = np.argsort(context, kind="stable")
        context, doc, cls, pos = context[by], doc[by], cls[by], pos[by]
        least = group_least(context, doc)
        out = []

        def take(member, low, high):
            out.append((doc[member], pos[member].astype(np.int64) - REACH + low, pos[member].astype(np.int64) - REACH + high + LENGTH, cls[member]))

        later = np.flatnonzero(doc > least[context])
        take(later, rows[context[later], CONTEXT].astype(np.int64), rows[context[later], CONTEXT + 1].astype(np.int64))
        # Contexts that share only the gram: compare their strings one by one.
        gram = grams_of(rows)
        gram = np.concatenate(([0], np.cumsum(gram[1:] != gram[:-1])))
        mixed = np.flatnonzero(np.bincount(gram)[gram] > 1)
        first_member = np.searchsorted(context, np.arange(len(rows) + 1))
        at = 0
        while at < len(mixed):
            to = min(len(mixed), at + COMPARED)
            while to < len(mixed) and gram[mixed[to]] == gram[mixed[to - 1]]:
                to += 1
            some = mixed[at:to]
            at = to
            which, strings = strings_of(rows[some])
            order, same = multikey_sort(strings)
            holder = least[some[which[order]]]
            earliest = group_least(same, holder)[same]
            hit = np.flatnonzero(holder > earliest)
            ctx, offset = some[which[order[hit]]], strings[order[hit], CONTEXT].astype(np.int64)
            # Members with the context's least document; the others have gone already.
            sizes = first_member[ctx + 1] - first_member[ctx]
            member = spread(first_member[ctx], sizes)
            offset = np.repeat(offset, sizes)
            own = doc[member] == np.repeat(least[ctx], sizes)
            take(member[own], offset[own], offset[own])
        doc_, start, end, cls_ = (np.concatenate(x) for x in zip(*out, strict=True))
        if not len(doc_):
            return
        # Overlapping stretches of one document become one before they travel.
        order = np.lexsort((start, cls_, doc_))
        doc_, start, end, cls_ = doc_[order], start[order], end[order], cls_[order]
        fresh = np.concatenate(([True], (doc_[1:] != doc_[:-1]) | (cls_[1:] != cls_[:-1])))
        number = np.cumsum(fresh) - 1
        shift = number * (1 << 33)
        s, e = covered(start + shift, end + shift)
        k = s >> 33
        heads = np.flatnonzero(fresh)
        doc_, cls_, start, end = doc_[heads][k], cls_[heads][k], s - (k << 33), e - (k << 33)
        order, runs = dealt(shard(doc_, n), n)
        yield messages([(i, pack(doc_[order[r]], start[order[r]], end[order[r]], cls_[order[r]])) for i, r in runs])

    return received.mapInArrow(lean(compare), MESSAGE)


def kept_bytes(docs: DataFrame, with_text: bool) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document.

    kept is the remaining text; bytes of characters that were cut through are left out of it.
    """
    spark, n = docs.sparkSession, parts(docs.sparkSession)
    docs = narrow(docs).select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = docs.filter(F.octet_length("text") >= LENGTH)

    m = FINER * n
    places = written(repeated_places(anchor_messages(long, m).repartitionById(m, "to"), n), "places")
    # The sampled grams: at most SAMPLE_EACH a bucket.
    sample = [np.frombuffer(r["payload"], np.uint8).reshape(-1, GRAM) for r in places.filter("to = -1").collect()]
    sample = np.unique(np.concatenate(sample), axis=0) if sample else np.zeros((0, GRAM), np.uint8)
    splitters = sample[np.unique(np.linspace(0, len(sample), n + 1)[1:-1].astype(int))] if len(sample) > n else sample
    at = per_document(places.filter("to >= 0").repartitionById(n, "to"), ["doc_id", "at", "hot"], "doc_id long, at array<long>, hot array<boolean>")
    found = compressed(long).join(at.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id")).drop("id")
    sent = context_messages(found, splitters, n).repartitionById(n, "to")
    gone = per_document(removals(sent, n).repartitionById(n, "to"), ["id", "starts", "ends", "kinds"], "id long, starts array<long>, ends array<long>, kinds array<long>")
    gone = written(gone, "gone")
    discard(places)

    # Copies of a text after its first document. The texts of a hot key stay many rows: only counts and hashes meet.
    text_key = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2")]
    firsts = long.select("doc_id", *text_key).groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = long.select("doc_id", *text_key).join(firsts, ["t1", "t2"]).filter("doc_id > first")
    copies = written(copies.groupBy(F.col("doc_id").alias("copy_id")).agg(F.collect_set(F.struct("t1", "t2")).alias("same")), "copies")

    marked = compressed_all(docs).join(gone, F.col("doc_id") == F.col("id"), "left").drop("id")
    marked = marked.join(copies, F.col("doc_id") == F.col("copy_id"), "left").withColumn("copy", F.coalesce(F.array_contains("same", F.struct("t1", "t2")), F.lit(False))).drop("copy_id", "same", "t2")

    def cut(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text_hash")}
            for doc, t1, cls, blob, starts, ends, kinds, copy in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "t1", "cls", "blob", "starts", "ends", "kinds", "copy")), strict=True):
                data = expand.decompress(blob)
                if copy:
                    s, e = np.array([0]), np.array([len(data)])
                elif starts:
                    own = np.array(kinds) == cls
                    s, e = covered(np.array(starts)[own], np.array(ends)[own])
                else:
                    s = e = np.zeros(0, np.int64)
                edges = [0, *(x for y in zip(s.tolist(), e.tolist(), strict=True) for x in y), len(data)]
                pieces = [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                left = b"".join(pieces)
                out["doc_id"].append(None if doc == NO_DOC else doc)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(left))
                out["n_spans"].append(len(s))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                if with_text:
                    out["text_hash"].append(t1)
                    out["kept"].append("".join(p.decode(errors="ignore") for p in pieces))
            if not with_text:
                del out["kept"], out["text_hash"]
            kinds_ = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds_.get(k, pa.string())) for k, v in out.items()})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string, text_hash long" * with_text
    return marked.mapInArrow(lean(cut), schema)


def compressed_all(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, cls, blob) of all texts."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"))

    def squeeze(batches):
        c = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", 4 << 20):
            data, offsets = texts(batch.column("text"))
            bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            cls = np.array([text_class(data[a:b]) & 0xFFFFFFFF for a, b in bounds], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "t1": batch.column("t1"), "t2": batch.column("t2"), "cls": pa.array(cls), "blob": pa.array([c.compress(data[a:b]) for a, b in bounds], pa.binary())})

    return keyed.mapInArrow(lean(squeeze), "doc_id long, t1 long, t2 long, cls long, blob binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut out of their texts; all columns stay. A null text stays null."""
    kept = written(kept_bytes(docs, with_text=True), "kept").filter("n_removed > 0")
    kept = kept.groupBy(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc_id"), "text_hash").agg(F.min("kept").alias("kept"))
    key = [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_DOC)), F.xxhash64(docs["text"])]
    joined = docs.join(kept, (key[0] == kept["doc_id"]) & (key[1] == kept["text_hash"]), "left")
    return joined.select(*[F.coalesce(kept["kept"], c).alias("text") if name == "text" else c for name, c in zip(docs.columns, columns_of(docs), strict=True)])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when strings of 50 bytes from earlier documents go."""
    return kept_bytes(table(spark, sf_dir, "documents"), with_text=False)
