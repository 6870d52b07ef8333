"""Line dedup (7): levelled sorted runs of line hashes.

Texts are split once: the hashes of their long lines are written by batches of descending doc_id. A batch's line keys,
hashed to 128 bits, are summed up to one entry (hash, documents, largest doc_id) each: a run, stored in buckets of the
hash whose files are sorted. A merge join with each run so far, which needs no shuffle and no sort of the run, tells the
keys that a later document already holds: new keys enter the batch's run with their doc_id, known keys only with their
count. `fan_out` runs of one level are merged bucket by bucket to one run of the next, so an entry is rewritten once a
level. The last compaction leaves one run of all keys; those found in at least `min_docs` documents say which lines go.

A line's key is the line without white space [\\x20\\x09-\\x0D] at its ends and with A-Z in lower case; keys of less than
`min_chars` code points stay. All lines of a dropped key go except those in the largest doc_id that
has it.

Nulls: a null text is one empty line. A null doc_id counts as smaller than any other. Rows that share a
doc_id count as one document for a key; those that share the largest doc_id of a key all keep it, and in each
row every line with the key. An empty table gives no rows. Very long texts and lines are taken whole. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, discard, free_name, lean, narrow, parts, remove, shared_dir, slices, table, written

MIN_CHARS, MIN_DOCS, FAN_OUT = 40, 5, 2
#: Batches at least; documents of a batch at most, about.
BATCHES, BATCH_DOCS = 4, 200_000_000
LINES = "doc_id long, t long, line int, h1 long, h2 long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
NO_DOC = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def keys_of(text: Column, min_chars: int) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars)


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


@contextmanager
def sorted_scans(spark: SparkSession):
    """Within it, scans of buckets of one sorted file count as sorted; the session's setting comes back after."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """Runs of (h1, h2, n_docs, last_doc), level by level: tables in buckets by hash, each bucket's file sorted by hash."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out, self.buckets = spark, fan_out, parts(spark)
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        path = shared_dir(self.spark, "run")
        name = f"lociflow_run_{path.rpartition('-')[2]}"
        df.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, lines: DataFrame) -> None:
        """lines: (h1, h2, doc_id), one row for each document and key, all older than what the runs hold."""
        batch = lines.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        known = F.lit(False)
        with sorted_scans(self.spark):
            for i, name in enumerate(self.names()):
                held = self.spark.table(name).select(*KEY, F.col("last_doc").isNotNull().alias(f"held{i}"))
                batch = batch.hint("merge").join(held, KEY, "left")
                known = known | F.coalesce(f"held{i}", F.lit(False))
            self.levels[0].append(self._write(batch.select(*KEY, "n_docs", F.when(~known, F.col("last_doc")).alias("last_doc"))))
            for k in range(len(self.levels)):
                if len(self.levels[k]) >= self.fan_out:
                    merged = self._one(self.levels[k])
                    self.levels[k] = []
                    if k + 1 == len(self.levels):
                        self.levels.append([])
                    self.levels[k + 1].append(merged)

    def _one(self, names: list[str]) -> str:
        """The runs as one, merged two by two: a merge join of buckets, without a shuffle."""
        first, *rest = names
        for name in rest:
            first, old = self._write(self._both(first, name)), [first, name]
            self.drop(old)
        return first

    def _both(self, a: str, b: str) -> DataFrame:
        x, y = (self.spark.table(n).select(*KEY, F.col("n_docs").alias(f"n{i}"), F.col("last_doc").alias(f"d{i}")) for i, n in enumerate((a, b)))
        n = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
        return x.hint("merge").join(y, KEY, "full").select(*KEY, n.alias("n_docs"), F.greatest("d0", "d1").alias("last_doc"))

    def compacted(self) -> DataFrame:
        """All runs as one."""
        with sorted_scans(self.spark):
            name = self._one(self.names())
        self.levels = [[name]]
        return self.spark.table(name)


def batch_number(docs: DataFrame, batches: int) -> Column:
    """The batch of a doc_id: 0 for the largest ones."""
    cuts = sorted(set(docs.select("doc_id").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)))
    return sum((F.when(F.col("doc_id") < F.lit(int(c)), 1).otherwise(0) for c in cuts), F.lit(0))


def repeated_lines(spark: SparkSession, path: str, min_docs: int) -> DataFrame:
    """(h1, h2, last_doc) of the keys found in at least min_docs documents, from the hashes stored by batch."""
    lines = spark.read.schema(LINES + ", batch int").parquet(path)
    runs = LineRuns(spark)
    for number in sorted(r[0] for r in lines.select("batch").distinct().collect()):  # the batches' numbers
        # Rows that share a doc_id are one document; a key that many documents share stays many rows until it is counted.
        runs.add(lines.filter(F.col("batch") == number).select(*KEY, "doc_id").distinct())
    if not runs.names():
        return spark.createDataFrame([], "h1 long, h2 long, last_doc long")
    out = written(runs.compacted().filter(F.col("n_docs") >= min_docs).select(*KEY, "last_doc"), "repeated")
    runs.drop(runs.names())
    return out


def gone_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """(doc_id, t, gone): the line numbers that go, by doc_id and hash of the text."""
    spark = docs.sparkSession
    docs = narrow(docs).select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    batches = batches or max(BATCHES, -(-docs.count() // BATCH_DOCS))
    each = F.posexplode(F.transform(F.split("text", "\n", -1), line_key)).alias("line", "key")
    at = docs.select("doc_id", F.xxhash64("text").alias("t"), batch_number(docs, batches).alias("batch"), each).filter(F.char_length("key") >= min_chars)
    path = shared_dir(spark, "lines")
    at.select("doc_id", "t", "line", *hashes(F.col("key")), "batch").write.partitionBy("batch").parquet(path)
    repeated = repeated_lines(spark, path, min_docs)
    gone = spark.read.schema(LINES).parquet(path).join(repeated, KEY).filter(F.col("doc_id") < F.col("last_doc"))
    out = written(gone.groupBy("doc_id", "t").agg(F.collect_set("line").alias("gone")), "gone")
    discard(repeated)
    remove(spark, path)
    return out


def marked(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs with the line numbers that go, as column `name`."""
    key = [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_DOC)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))]
    gone = gone.withColumnRenamed("gone", name)
    return docs.join(gone, (key[0] == gone["doc_id"]) & (key[1] == gone["t"]), "left").select(*columns_of(docs), gone[name])


def without_lines(text: str, gone: list[int] | None) -> str:
    if not gone:
        return text
    drop = set(gone)
    return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in drop])


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every document."""
    docs = narrow(docs)

    def cut(batches):
        for batch in slices(batches, "text", 8 << 20):
            n, dropped, kept = [], [], []
            for text, gone in zip(pc.fill_null(batch.column("text"), "").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                n.append(text.count("\n") + 1)
                dropped.append(len(gone or ()))
                kept.append(without_lines(text, gone))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(kept, pa.string())})

    return marked(docs, gone_lines(docs), "gone").mapInArrow(lean(cut), "doc_id long, n_lines long, n_dropped long, kept string")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with their texts cut; all columns stay."""
    schema, name = docs.schema, free_name(docs, "gone")

    def cut(batches):
        for batch in slices(batches, "text", 8 << 20):
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else without_lines(t, g) for t, g in zip(batch.column(at).to_pylist(), batch.column(name).to_pylist(), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).select(schema.names)

    return marked(docs, gone_lines(docs), name).mapInArrow(lean(cut), schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and dropped lines of every document, and the digest of what is kept."""
    kept = kept_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, t.i AS i, t.line AS line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
       LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS i) t
), r AS (
  SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.*, r.last_doc IS NOT NULL AND l.doc_id < r.last_doc AS gone FROM l LEFT JOIN r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
