"""Queries of the sequence functions, over the documents' texts and the parts' names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence
from ..sources.storage import table

QUERIES, ORACLES = {}, {}


def query(name, oracle):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


_count = "length(regexp_replace(text, '[^{}]', '', 'g'))"


@query("seq_gc_percent", f"SELECT doc_id, 100.0::DOUBLE * {_count.format('GCgc')} / nullif({_count.format('ACGTUacgtu')}, 0) AS gc FROM documents")
def seq_gc_percent(spark, d):
    return table(spark, d, "documents").select("doc_id", sequence.gc_percent(F.col("text")).alias("gc"))


@query("seq_reverse_complement", "SELECT p_partkey, translate(reverse(p_name), 'ACGTUacgtu', 'TGCAAtgcaa') AS rc FROM part")
def seq_reverse_complement(spark, d):
    return table(spark, d, "part").select("p_partkey", sequence.reverse_complement(F.col("p_name")).alias("rc"))


@query(
    "seq_complexity_class",
    "SELECT doc_id, 3 - " + " - ".join(f"(length(q) - length(replace(q, '{b}', '')) < length(q) * 20 // 100)::INT" for b in "ACGT") + " AS cls FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS q FROM documents)",
)
def seq_complexity_class(spark, d):
    bases = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    return table(spark, d, "documents").select("doc_id", sequence.complexity_class(bases, 20).alias("cls"))


@query("text_one_blank", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS digest FROM documents")
def text_one_blank(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(sequence.one_blank(F.col("text")), 256).alias("digest"))
