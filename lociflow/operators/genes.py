"""Loci against genes: components touched, splice sites, flanks, the gene that a locus belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import genes as G
from .intervals import overlap_join

STRUCTURE = ["strand", "exons", "ts", "te"]


def _pairs(loci: DataFrame, genes: DataFrame, distance: int) -> DataFrame:
    return overlap_join(loci.select("src", "chrom", "s", "e"), genes.select("chrom", "s", "e", *STRUCTURE).distinct(), flank=distance)


def _summed(loci: DataFrame, pairs: DataFrame, bits: Column, keep: list[str] = ()) -> DataFrame:
    """(src, bits) and columns to keep: the bits of all of a locus' genes together, 0 without any."""
    found = pairs.select("src", bits.alias("b")).groupBy("src").agg(F.bit_or("b").alias("b"))
    return loci.select("src", *keep).join(found, "src", "left").select("src", F.coalesce("b", F.lit(0)).cast("int").alias("bits"), *keep)


def component_bits(loci: DataFrame, genes: DataFrame, distance: int, keep: list[str] = ()) -> DataFrame:
    """(src, bits): which components of any gene each locus touches. genes: chrom, s, e, strand, exons, ts, te."""
    c = F.col
    return _summed(loci, _pairs(loci, genes, distance), G.component_bits(c("s"), c("e"), c("r_s"), c("r_e"), c("r_strand"), c("r_exons"), c("r_ts"), c("r_te"), distance), keep)


def splice_bits(loci: DataFrame, genes: DataFrame, overlap: int) -> DataFrame:
    """(src, bits): which kinds of splice sites each locus covers by `overlap` bases on both sides."""
    c = F.col
    return _summed(loci, _pairs(loci, genes, 0), G.splice_bits(c("s"), c("e"), c("r_strand"), c("r_exons"), overlap))


def touching(loci: DataFrame, genes: DataFrame, bit: int, distance: int = 0) -> DataFrame:
    """src of the loci that touch such a component of any gene."""
    return component_bits(loci, genes, distance).filter(F.col("bits").bitwiseAND(bit) > 0).select("src")


def gene_of(loci: DataFrame, genes: DataFrame, flank: int) -> DataFrame:
    """(src, name, how) of the gene of each locus: the smallest that holds it, else the nearest it is upstream of, else downstream of.

    A gene holds a locus that lies inside; flanks reach `flank` bases, along the strand. Ties fall to the nearest, the
    smaller and the first name. Loci without a gene are left out. genes: chrom, s, e, strand, name.
    """
    p = overlap_join(loci.select("src", "chrom", "s", "e"), genes.select("chrom", "s", "e", "strand", "name").distinct(), flank=flank)
    left, right = F.col("s") < F.col("r_s"), F.col("e") > F.col("r_e")
    inside = ~left & ~right
    apart = F.greatest(F.col("r_s") - F.col("e"), F.col("s") - F.col("r_e"), F.lit(0))
    up = F.when(F.col("r_strand") == "-", right & ~left).otherwise(left & ~right)
    p = p.withColumns({"how": F.when(inside, 0).when(up, 1).otherwise(2), "apart": apart, "size": F.col("r_e") - F.col("r_s")})
    best = F.min(F.struct("how", "apart", "size", F.col("r_name").alias("name"))).alias("best")
    return p.groupBy("src").agg(best).select("src", "best.name", "best.how")


def nth_overlapping(loci: DataFrame, elements: DataFrame, least: int, nth: int) -> DataFrame:
    """(src, name, start, bases) of the nth element, by descending start, that shares at least `least` bases with each locus."""
    p = overlap_join(loci.select("src", "chrom", "s", "e"), elements.select("chrom", "s", "e", "name"))
    p = p.withColumns({"start": F.greatest("s", "r_s"), "bases": F.least("e", "r_e") - F.greatest("s", "r_s") + 1}).filter(F.col("bases") >= least)
    rank = F.row_number().over(Window.partitionBy("src", "s", "e").orderBy(F.desc("r_s"), F.desc("r_e"), "r_name"))
    return p.withColumn("rank", rank).filter(F.col("rank") == nth).select("src", F.col("r_name").alias("name"), "start", "bases")


def n_overlapping(loci: DataFrame, elements: DataFrame, least: int) -> DataFrame:
    """(src, n): how many elements share at least `least` bases with each locus."""
    p = overlap_join(loci.select("src", "chrom", "s", "e"), elements.select("chrom", "s", "e"))
    n = p.filter(F.least("e", "r_e") - F.greatest("s", "r_s") + 1 >= least).groupBy("src").agg(F.count("*").alias("n"))
    return loci.select("src").join(n, "src", "left").select("src", F.coalesce("n", F.lit(0)).alias("n"))


def tolerant_dropouts(ref: DataFrame, rel: DataFrame, percent: int, least: int) -> DataFrame:
    """ref rows with no rel element of whose two ends each is within max(percent of ref's length, least) bases of ref's."""
    near = F.greatest(F.floor((F.col("e") - F.col("s") + 1) * percent / 100), F.lit(least))
    p = overlap_join(ref.select("src", "chrom", "s", "e", near.alias("near")), rel.select("chrom", "s", "e").distinct(), flank=max(least, 1))
    same = (F.abs(F.col("s") - F.col("r_s")) <= F.col("near")) & (F.abs(F.col("e") - F.col("r_e")) <= F.col("near"))
    return ref.join(p.filter(same).select("src", "chrom", "s", "e").distinct(), ["src", "chrom", "s", "e"], "left_anti")


def covered_uniques(ref: DataFrame, rel: DataFrame) -> DataFrame:
    """ref on chromosomes that rel has at all: others are not looked at."""
    return ref.join(rel.select("chrom").distinct(), "chrom", "left_semi")


def split_elements(elements: DataFrame) -> DataFrame:
    """elements with n, ordinal (from 0), first and last among those of one source, by strand, chrom, start and length."""
    w = Window.partitionBy("src").orderBy("strand", "chrom", "s", "e")
    n, at = F.count("*").over(Window.partitionBy("src")), F.row_number().over(w) - 1
    return elements.withColumns({"n": n, "ordinal": at}).withColumns({"is_split": F.col("n") > 1, "is_first": F.col("ordinal") == 0, "is_last": F.col("ordinal") == F.col("n") - 1})
