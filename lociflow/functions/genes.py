"""Gene structure on columns: exons are an ascending array of closed (s, e), the coding span is [ts, te].

A gene whose coding span starts where it ends (or is null) has no coding bases, and so no untranslated ends.
Lengths are those of the named parts; bases beyond the coding span's other end are not counted with them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a gene's components, and the regions in order of priority.
CDS, UTR5, UTR3, INTRON, UPSTREAM, DOWNSTREAM = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20
INTRON_EXON, EXON_INTRON, INTERGENIC = 0x40, 0x80, 0x100
PRIORITY = ((CDS, 6), (UTR5, 5), (UTR3, 4), (INTRON, 3), (UPSTREAM, 2), (DOWNSTREAM, 1))
REGIONS = {6: "CDS", 5: "5'UTR", 4: "3'UTR", 3: "intron", 2: "upstream", 1: "downstream", 0: "intergenic"}


def _sum(parts: Column, size) -> Column:
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + F.greatest(size(x), F.lit(0)))


def transcribed_length(exons: Column) -> Column:
    return _sum(exons, lambda x: x["e"] - x["s"] + 1)


def cds_length(exons: Column, ts: Column, te: Column) -> Column:
    inside = _sum(exons, lambda x: F.least(x["e"], te) - F.greatest(x["s"], ts) + 1)
    return F.when(ts < te, inside).otherwise(0)


def _before(exons: Column, ts: Column) -> Column:
    return _sum(exons, lambda x: F.least(x["e"], ts - 1) - x["s"] + 1)


def _after(exons: Column, te: Column) -> Column:
    return _sum(exons, lambda x: x["e"] - F.greatest(x["s"], te + 1) + 1)


def utr5_length(exons: Column, ts: Column, te: Column, strand: Column) -> Column:
    return F.when(ts < te, F.when(strand == "-", _after(exons, te)).otherwise(_before(exons, ts))).otherwise(0)


def utr3_length(exons: Column, ts: Column, te: Column, strand: Column) -> Column:
    return F.when(ts < te, F.when(strand == "-", _before(exons, ts)).otherwise(_after(exons, te))).otherwise(0)


def n_exons(exons: Column) -> Column:
    return F.size(exons)


def n_introns(exons: Column) -> Column:
    return F.greatest(F.size(exons) - 1, F.lit(0))


def introns(exons: Column) -> Column:
    """The gaps between neighbouring exons, empty ones left out."""
    gaps = F.transform(F.slice(exons, 1, n_introns(exons)), lambda x, i: F.struct((x["e"] + 1).alias("s"), (F.get(exons, i + 1)["s"] - 1).alias("e")))
    return F.filter(gaps, lambda g: g["s"] <= g["e"])


def exon(exons: Column, nth: Column | int) -> Column:
    """The nth exon from 1, null beyond the last."""
    return F.get(exons, F.lit(nth) - 1)


def intron(exons: Column, nth: Column | int) -> Column:
    return F.get(introns(exons), F.lit(nth) - 1)


def transcript_to_locus(exons: Column, s: Column, offset: Column) -> Column:
    """The locus of an offset in the transcript: before the start it counts from there, beyond the last exon from its end."""
    start = F.struct(offset.cast("bigint").alias("rest"), F.lit(None).cast("bigint").alias("at"), (s - 1).cast("bigint").alias("end"))

    def step(a, x):
        size = x["e"] - x["s"] + 1
        here = a["at"].isNull() & (a["rest"] < size)
        at = F.when(here, x["s"] + a["rest"]).otherwise(a["at"]).cast("bigint")
        return F.struct((a["rest"] - F.when(a["at"].isNull() & ~here, size).otherwise(0)).cast("bigint").alias("rest"), at.alias("at"), x["e"].cast("bigint").alias("end"))

    inside = F.aggregate(exons, start, step, lambda a: F.coalesce(a["at"], a["end"] + 1 + a["rest"]))
    return F.when(offset < 0, s + offset).otherwise(inside)


def _bit(hit: Column, bit: int) -> Column:
    return F.when(hit, bit).otherwise(0)


def component_bits(s: Column, e: Column, gene_s: Column, gene_e: Column, strand: Column, exons: Column, ts: Column, te: Column, distance: int) -> Column:
    """Which components of a gene a locus [s, e] touches; upstream and downstream reach `distance` bases.

    A gene without a coding span has no CDS or ends. Downstream of the minus strand reaches one base less.
    """
    minus = strand == "-"
    left, right = (s < gene_s) & (e >= gene_s - distance), (s <= gene_e + distance) & (e > gene_e)
    left_less = (s < gene_s) & (e > gene_s - distance)
    flanks = _bit(F.when(minus, right).otherwise(left), UPSTREAM).bitwiseOR(_bit(F.when(minus, left_less).otherwise(right), DOWNSTREAM)) if distance > 0 else F.lit(0)
    on = lambda f: F.exists(exons, lambda x: (s <= x["e"]) & (e >= x["s"]) & f(x))
    inside = (s <= gene_e) & (e >= gene_s)
    low, high = F.greatest(s, gene_s), F.least(e, gene_e)  # the part on the gene
    before, after = on(lambda x: (low < ts) & (ts > x["s"])), on(lambda x: (high > te) & (te < x["e"]))
    coding = ts < te
    cds = coding & on(lambda x: (low <= te) & (high >= ts))
    five, three = coding & F.when(minus, after).otherwise(before), coding & F.when(minus, before).otherwise(after)
    gap = F.exists(introns(exons), lambda g: (low <= g["e"]) & (high >= g["s"]))
    parts = _bit(cds, CDS).bitwiseOR(_bit(five, UTR5)).bitwiseOR(_bit(three, UTR3)).bitwiseOR(_bit(gap, INTRON))
    return flanks.bitwiseOR(F.when(inside, parts).otherwise(0))


def splice_bits(s: Column, e: Column, strand: Column, exons: Column, overlap: int) -> Column:
    """Splice sites that a locus covers with at least `overlap` bases on both sides: exon to intron and intron to exon, along the strand."""
    gaps = introns(exons)
    first = F.exists(gaps, lambda g: (s <= g["s"] - overlap) & (e >= g["s"] - 1 + overlap))
    second = F.exists(gaps, lambda g: (s <= g["e"] + 1 - overlap) & (e >= g["e"] + overlap))
    minus = strand == "-"
    return _bit(F.when(minus, second).otherwise(first), EXON_INTRON).bitwiseOR(_bit(F.when(minus, first).otherwise(second), INTRON_EXON))


def region_index(bits: Column) -> Column:
    """The region of highest priority among bits: CDS, 5'UTR, 3'UTR, intron, upstream, downstream, intergenic (0)."""
    return F.coalesce(*[F.when(bits.bitwiseAND(b) > 0, i) for b, i in PRIORITY], F.lit(0))


def region_name(index: Column) -> Column:
    return F.coalesce(*[F.when(index == i, n) for i, n in REGIONS.items()])


def length_class(length: Column, edges: list[int]) -> Column:
    """The number of edges that a length reaches."""
    return sum(((length >= x).cast("int") for x in edges), F.lit(0))
