"""Token-ID output (1): flat files of unsigned integers with 64-bit document offsets.

Documents are range-partitioned by doc_id and sorted in each partition, so that the parts, one after
the other, hold the ids of all documents in ascending order. A part is four files:

``NNNNN-attempt.bin``  the ids, little-endian, 16 bits each if every id of the vocabulary fits, else 32
``NNNNN-attempt.ids``  doc_id of each document, 64 bits; the manifest says how many come first that have none
``NNNNN-attempt.len``  number of ids of each document, 64 bits
``NNNNN-attempt.off``  n + 1 offsets in ids, 64 bits, counted over all parts

The first pass writes ids and lengths and reports each part's totals; a part's base is the sum of the
totals before it; the second pass turns lengths into offsets. Files of lost attempts are never listed.

Nulls: a null text is empty, a null doc_id sorts first. Equal doc_ids stand next to each other,
ordered by their texts' hash, so that ranges can split them too. An empty table gives no parts. Very long texts are
taken whole; files are read in stretches of READ tokens. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, narrow, parts, shared_dir, slices, store, stored_bytes, table, written
from .tokens import SLICE, default_tokenizer, encoder

NO_ID = -(1 << 63)
MANIFEST = "part int, path string, n_docs long, n_null long, n_tokens long, width int"
#: Tokens that are read back at once, about; a longer document comes alone.
READ = 4 << 20


def in_order(docs: DataFrame, n: int) -> DataFrame:
    """Documents in n ranges of doc_id, each range sorted; rows that share a doc_id, or have none, can fall in several ranges."""
    hashed = docs.withColumn("h", F.xxhash64("text"))
    return hashed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None, into: str | None = None) -> DataFrame:
    """Write the ids of docs; returns the manifest: part, path, n_docs, n_tokens, width, base."""
    spark = docs.sparkSession
    into = into or shared_dir(spark, "tokens")

    def write(batches):
        context = TaskContext.get()
        enc = encoder(tokenizer)
        width = 2 if max(enc.whole.get_vocab_size(True), end_id or 0) <= 1 << 16 else 4
        path = f"{into}/{context.partitionId():05d}-{context.taskAttemptId()}"
        lengths, names, total, n_null = [], [], 0, 0

        def encoded():
            nonlocal total, n_null
            for batch in slices(batches, "text", SLICE):
                ids, n = enc.encode(batch.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(n), end_id)
                    n = n + 1
                lengths.append(n)
                n_null += batch.column("doc_id").null_count
                names.append(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
                total += len(ids)
                yield ids.astype(f"<u{width}").tobytes()

        first = next(chunks := encoded(), None)
        if first is None:
            return
        store(f"{path}.bin", (x for y in ([first], chunks) for x in y))
        store(f"{path}.ids", (x.astype("<i8").tobytes() for x in names))
        store(f"{path}.len", (x.astype("<i8").tobytes() for x in lengths))
        yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "path": [path], "n_docs": [sum(map(len, lengths))], "n_null": [n_null], "n_tokens": [total], "width": pa.array([width], pa.int32())})

    manifest = written(in_order(narrow(docs), parts(spark)).mapInArrow(lean(write), MANIFEST), "manifest")
    # One row a part: bounded by the number of partitions, not by the documents.
    rows = sorted(manifest.collect(), key=lambda r: r["part"])
    bases = np.cumsum([0, *[r["n_tokens"] for r in rows]]).tolist()
    return spark.createDataFrame([(*r, b) for r, b in zip(rows, bases, strict=False)], MANIFEST + ", base long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of the manifest."""

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                path, width = r["path"], r["width"]
                n = np.array(stored_bytes(f"{path}.len")).view("<i8")
                store(f"{path}.off", [(r["base"] + np.concatenate(([0], np.cumsum(n)))).astype("<i8").tobytes()])
                off = np.array(stored_bytes(f"{path}.off")).view("<i8")
                names = np.array(stored_bytes(f"{path}.ids")).view("<i8")
                at = 0
                while at < len(names):
                    to = min(at + 10_000, max(at + 1, int(np.searchsorted(off, off[at] + READ, side="right")) - 1), len(names))
                    o = off[at : to + 1] - r["base"]
                    ids = stored_bytes(f"{path}.bin", int(o[0]) * width, int(o[-1] - o[0]) * width).view(f"<u{width}").astype("<u4")
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((o[:-1] - o[0]).tolist(), (o[1:] - o[0]).tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names[at:to], pa.int64(), mask=np.arange(at, to) < r["n_null"]), "start": pa.array(o[:-1] + r["base"], pa.int64()), "n_tokens": pa.array(np.diff(o), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                    at = to

    spark = manifest.sparkSession
    spread_out = manifest.repartition(max(1, parts(spark)), F.col("part"))
    return spread_out.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in files, and what is read back from them."""
    manifest = write_tokens(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=1)
    return read_tokens(manifest)
