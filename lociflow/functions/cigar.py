"""CIGAR strings as columns; an asterisk, an empty text or null has length 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(cigar: Column, kinds: str) -> Column:
    """The summed lengths of operations of the given kinds."""
    runs = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, n: a + n.cast("bigint"))


def aligned(cigar: Column) -> Column:
    return total(cigar, "M=Xmx")


def on_reference(cigar: Column) -> Column:
    return total(cigar, "MDN=Xmdnx")


def on_read(cigar: Column) -> Column:
    return total(cigar, "MIS=Xmisx")


def coalesced(cigar: Column) -> Column:
    """Neighbouring operations of one kind as one; null or an asterisk stay."""
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHPX=])"), F.lit(1))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("kind"))

    def add(a, run):
        n, kind = F.regexp_extract(run, r"\d+", 0).cast("bigint"), F.substring(run, -1, 1)
        same = a["kind"] == kind
        text = F.concat(a["done"], F.when(a["n"] > 0, F.concat(a["n"].cast("string"), a["kind"])).otherwise(""))
        return F.struct(F.when(same, a["done"]).otherwise(text).alias("done"), F.when(same, a["n"] + n).otherwise(n).alias("n"), kind.alias("kind"))

    whole = F.aggregate(runs, start, add, lambda a: F.concat(a["done"], F.when(a["n"] > 0, F.concat(a["n"].cast("string"), a["kind"])).otherwise("")))
    return F.when(cigar == "*", cigar).otherwise(whole)
