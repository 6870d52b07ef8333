"""Operators on reads: qualities, duplicates, contaminants, tandem repeats. A read is an id, a sequence and its qualities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By schema, the code of quality 0 and the highest quality that counts.
SCHEMAS = {0: (33, 41), 1: (64, 41), 2: (64, 41), 3: (64, 41), 4: (33, 41)}


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def phred(schema: int) -> Callable[[Column], Column]:
    """Quality of a character by a schema, between 0 and the highest that counts."""
    zero, most = SCHEMAS[schema]
    return lambda c: F.least(F.greatest(F.ascii(c) - zero, F.lit(0)), F.lit(most))


def quality_histogram(reads: DataFrame, quality: Callable[[Column], Column]) -> DataFrame:
    """(at, q, n): how many reads have quality q at offset `at`. reads: qual."""
    each = reads.filter("qual is not null").select(F.posexplode(characters(F.col("qual"))).alias("at", "c"))
    return each.groupBy(F.col("at").cast("bigint").alias("at"), quality(F.col("c")).alias("q")).agg(F.count("*").alias("n"))


def log_error_free(qual: Column, quality: Callable[[Column], Column]) -> Column:
    """Log of the chance that all bases of a read are right."""
    return F.aggregate(characters(qual), F.lit(0.0), lambda a, c: a + F.log(1 - F.pow(F.lit(10.0), -quality(c) / 10.0)))


def error_free(qual: Column, schema: int) -> Column:
    """Chance that all bases of a read are right, by the qualities of a schema; quality 0 is never right."""
    return F.exp(log_error_free(qual, phred(schema)))


def quality_filtered(reads: DataFrame, schema: int, least_mean: float, unknown: str = "N") -> DataFrame:
    """Reads without an unknown base whose mean quality is at least least_mean. reads: seq, qual."""
    total = F.aggregate(characters(F.col("qual")), F.lit(0).cast("bigint"), lambda a, c: a + phred(schema)(c))
    return reads.filter(~F.contains(F.upper("seq"), F.lit(unknown)) & (total >= least_mean * F.char_length("qual")))


def unknown_by_offset(reads: DataFrame, unknown: str = "N") -> DataFrame:
    """(at, n): how many reads have an unknown base at each offset."""
    each = reads.select(F.posexplode(characters(F.col("seq"))).alias("at", "c")).filter(F.upper("c") == unknown)
    return each.groupBy(F.col("at").cast("bigint").alias("at")).agg(F.count("*").alias("n"))


def kmers_by_offset(index: DataFrame) -> DataFrame:
    """(at, kmer, n) of a k-mer index: how many reads have each k-mer at each offset."""
    return index.groupBy("at", "kmer").agg(F.count("*").alias("n"))


def pair_duplicates(pairs: DataFrame, either_way: bool = True) -> DataFrame:
    """(id, copies): the first of all pairs with the same two sequences, either way round if so asked. pairs: id, seq1, seq2."""
    one, two = F.col("seq1"), F.col("seq2")
    key = [F.least(one, two), F.greatest(one, two)] if either_way else [one, two]
    named = pairs.select("id", F.sha2(F.concat_ws("\x00", *key), 256).alias("h"))
    return named.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("copies")).drop("h")


def stacks(reads: DataFrame) -> DataFrame:
    """(seq, n, first): equal sequences as one, with how many there are and the first id."""
    return reads.groupBy("seq").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def split_pairs(reads: DataFrame, flip: bool) -> DataFrame:
    """(id, mate, seq): both halves of each read, the second one on the other strand if so asked; an odd middle base goes to the first."""
    from ..functions.sequence import reverse_complement

    half = F.ceil(F.char_length("seq") / 2).cast("int")
    second = F.substring(F.col("seq"), half + 1, F.char_length("seq"))
    mates = F.array(F.struct(F.lit(1).alias("mate"), F.left("seq", half).alias("seq")), F.struct(F.lit(2).alias("mate"), (reverse_complement(second) if flip else second).alias("seq")))
    return reads.select("id", F.inline(mates))


def overlaps_any_other(overlaps: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads that overlap any other one. overlaps: a, b."""
    ids = overlaps.select(F.col("a").alias("id")).union(overlaps.select("b")).distinct()
    return reads.join(ids, "id", "left_semi")


def tandem_repeats(seqs: DataFrame, unit_least: int, unit_most: int, least: int, most: int) -> DataFrame:
    """(id, at, unit, n): runs of `least` to `most` copies of a unit of unit_least to unit_most letters, found from the left for each unit length.

    A unit of one letter repeated, or of a shorter unit repeated, isn't one; runs longer than `most` copies are left out.
    """
    import re

    patterns = [(k, re.compile(rf"([A-Za-z]{{{k}}})\1{{{least - 1},}}", re.I)) for k in range(unit_least, unit_most + 1)]

    def of_shorter(unit: str) -> bool:
        return any(len(unit) % m == 0 and unit == unit[:m] * (len(unit) // m) for m in range(1, len(unit)))

    def find(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, seq in zip(pdf["id"], pdf["seq"], strict=True):
                for k, p in patterns:
                    for m in p.finditer(seq or ""):
                        unit, n = m[1].upper(), len(m[0]) // k
                        if n <= most and not (k > 1 and of_shorter(unit)) and k > 1:
                            rows.append((name, m.start(), unit, n))
            yield pd.DataFrame(rows, columns=["id", "at", "unit", "n"])

    return seqs.select("id", "seq").mapInPandas(find, f"id {dict(seqs.dtypes)['id']}, at long, unit string, n long")


def merged_pairs(pairs: DataFrame, least: int, rate: float) -> DataFrame:
    """(id, size, seq): pairs whose first read's end is the second read's start on the other strand, as one read.

    The longest overlap of at least `least` bases and at most `rate` substitutions a base; where bases differ, the
    one of higher quality stands, of equals the first read's. size is 0 and seq null without one.
    pairs: id, seq1, qual1, seq2, qual2.
    """

    def merge(batches):
        import numpy as np
        import pandas as pd

        flip = str.maketrans("ACGTUacgtu", "TGCAAtgcaa")
        for pdf in batches:
            rows = []
            for name, s1, q1, s2, q2 in pdf.itertuples(index=False, name=None):
                size, seq = 0, None
                if s1 and s2:
                    s2, q2 = s2[::-1].translate(flip), q2[::-1]
                    x, y = np.array(list(s1)), np.array(list(s2))
                    for n in range(min(len(s1), len(s2)), least - 1, -1):
                        if (x[-n:] != y[:n]).sum() <= int(n * rate):
                            both = np.where(np.array(list(q1[-n:])) >= np.array(list(q2[:n])), x[-n:], y[:n])
                            size, seq = n, s1[:-n] + "".join(both) + s2[n:]
                            break
                rows.append((name, size, seq))
            yield pd.DataFrame(rows, columns=["id", "size", "seq"])

    return pairs.select("id", "seq1", "qual1", "seq2", "qual2").mapInPandas(merge, f"id {dict(pairs.dtypes)['id']}, size int, seq string")
