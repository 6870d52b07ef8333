"""Media columns (6): content-addressed payloads in tar shards, read back by range.

A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, are the samples of an
8-bit grey image of 576 columns, stored as a PNG file: lossless, and compressed because the samples
are text. Each task writes one tar shard of the payloads that it meets first, named by their SHA-256;
rows carry digest, shard, offset and length, never the payload. A digest that several tasks stored
gets the least of its places.

Reading back is two kinds of range reads: the header alone (signature and IHDR, 33 bytes) fills width, height and
bit depth; the whole range gives the samples. `feature` is a digest of the picture: the mean of each
of 16 equal bands of columns, as hexadecimal bytes.

Nulls: a null text is empty (one row of padding); a null doc_id stays null. Repeated rows each get a
row. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, lean, narrow, parts, shared_dir, slices, stored_bytes, table, written

COLUMNS, PAD, LEVEL = 576, 255, 3
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG of COLUMNS columns."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    lines = np.zeros((len(rows), COLUMNS + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", COLUMNS, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png() made."""
    width, height, _ = png_header(data[:HEADER])
    at, packed = HEADER, b""
    while data[at + 4 : at + 8] != b"IEND":
        size = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    size = max(1, -(-len(data) // COLUMNS)) * COLUMNS
    return len(data), data.ljust(size, bytes([PAD]))


def write_shards(docs: DataFrame, into: str | None = None) -> DataFrame:
    """Store all payloads; rows (doc_id, n_bytes, digest, shard, offset, length) of where each task put them."""
    into = into or shared_dir(docs.sparkSession, "media")

    def write(batches):
        context = TaskContext.get()
        shard = f"{into}/{context.partitionId():05d}-{context.taskAttemptId()}.tar"
        places: dict[bytes, tuple[int, int]] = {}
        at, out = 0, None
        for batch in slices(batches, "text", 8 << 20):
            if out is None:
                system, path = filesystem(shard)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(path)
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in places:
                    image = to_png(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(image)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + image + bytes(-len(image) % 512))
                    places[digest] = (at + len(head), len(image))
                    at += len(head) + len(image) + -len(image) % 512
                rows.append((doc, n, digest, shard, *places[digest]))
            names = ("doc_id", "n_bytes", "digest", "shard", "offset", "length")
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for k, t, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return written(narrow(docs).mapInArrow(lean(write), "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"), "places")


def placed(rows: DataFrame) -> DataFrame:
    """One place (digest, shard, offset, length) for each digest."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


def media_columns(places: DataFrame) -> DataFrame:
    """(digest, width, height, depth, payload columns, stored columns, feature) of every place, by range reads."""

    def look(batches):
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                start, length = r["offset"], r["length"]
                width, height, depth = png_header(stored_bytes(r["shard"], start, HEADER).tobytes())
                data = stored_bytes(r["shard"], start, length).tobytes()
                payload = from_png(data)
                bands = np.frombuffer(payload, np.uint8).reshape(height, 16, -1).mean(axis=(0, 2))
                rows.append((r["digest"], width, height, depth, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), bytes(bands.astype(np.uint8)).hex()))
                if len(rows) == 2000:
                    yield _media_batch(rows)
                    rows = []
            if rows:
                yield _media_batch(rows)

    spark = places.sparkSession
    # Dealt by digest: a shard's payloads are read by many tasks, each range on its own.
    return places.repartition(parts(spark), "digest").sortWithinPartitions("shard", "offset").mapInArrow(lean(look), MEDIA)


MEDIA = "digest binary, width long, height long, depth long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _media_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in MEDIA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload and media columns of every document, read back from the shards."""
    rows = write_shards(table(spark, sf_dir, "documents"))
    found = media_columns(placed(rows))
    return rows.select("doc_id", "n_bytes", "digest").join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth")
