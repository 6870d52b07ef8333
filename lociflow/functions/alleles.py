"""Alleles of one place in a byte: two bits of confidence (0 to 3) for each of A, C, G and T, from the top."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = {"A": 6, "C": 4, "G": 2, "T": 0}

#: What four bytes stand for, against the rule in `bases`.
UNLIKE_RULE = {0x50: "C", 0x60: "AC", 0x0A: "T", 0x06: "GT"}


def level(alleles: Column, base: str) -> Column:
    return F.shiftright(alleles, BASES[base]).bitwiseAND(3)


def haploid(alleles: Column) -> Column:
    """The allele of highest confidence at full confidence; the first of A, C, G and T on a tie, 0 for none."""
    top = F.greatest(*(level(alleles, b) for b in BASES))
    return reduce(lambda out, b: F.when(level(alleles, b) == top, 3 << BASES[b]).otherwise(out), reversed(BASES), F.lit(None).cast("int")) * F.when(top > 0, 1).otherwise(0)


def diploid(alleles: Column) -> Column:
    """haploid, with the next best allele unless the best has full confidence."""
    one = haploid(alleles)
    return F.when(alleles.bitwiseAND(one) == one, one).otherwise(one.bitwiseOR(haploid(alleles.bitwiseAND(F.bitwise_not(one)))))


def single(alleles: Column) -> Column:
    """Whether at most one allele is there."""
    return sum((level(alleles, b) > 0).cast("int") for b in BASES) <= 1


def bases(alleles: Column) -> Column:
    """The one or two bases that a byte stands for; N if there is no telling.

    A lone allele is its base; of confidences 2 and 1 the higher is; two equal ones below 3 are both.
    """
    levels = {b: level(alleles, b) for b in BASES}
    top = F.greatest(*levels.values())
    total = sum(levels.values())
    at_top = F.concat(*(F.when(v == top, b).otherwise("") for b, v in levels.items()))
    some = F.when(top == 0, "N").when(total == top, at_top).when((top == 2) & (total == 3), at_top).when((top < 3) & (total == 2 * top) & (F.length(at_top) == 2), at_top).otherwise("N")
    return reduce(lambda out, kv: F.when(alleles == kv[0], kv[1]).otherwise(out), UNLIKE_RULE.items(), some)
