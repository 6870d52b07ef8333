"""Shared storage, table reading and batching for the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import discard, remove, shared_dir, table, written  # noqa: F401


#: Most bytes of rows that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def stored_bytes(uri: str, start: int = 0, length: int | None = None) -> np.ndarray:
    """Bytes of a stored file as uint8: mapped into memory if the file is local, else a range read."""
    from pyarrow import fs

    system, path = filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        whole = np.memmap(path, dtype=np.uint8, mode="r") if system.get_file_info(path).size else np.empty(0, np.uint8)
        return whole[start : None if length is None else start + length]
    with system.open_input_file(path) as f:
        size = f.size() - start if length is None else length
        return np.frombuffer(f.read_at(size, start), dtype=np.uint8)


def store(uri: str, chunks) -> None:
    """Write chunks of bytes to a new file."""
    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as f:
        for x in chunks:
            f.write(x)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batches with about `most` bytes of text each (a longer row comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, offsets) of a text column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start .. start + length - 1 of every run, one run after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def release() -> None:
    """Give memory that is free in this process back to the system: idle workers keep none of it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores at its end as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list:
    """The columns of df, whatever their names."""
    return [df[f"`{c}`"] for c in df.columns]


def lean(f):
    """f, a function on an iterator of batches, followed by release()."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under names of its own; other columns never clash.

    Arrow batches of texts are held to BATCH_BYTES, as texts can be long.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
