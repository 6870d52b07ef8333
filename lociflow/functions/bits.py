"""Sets of small numbers as arrays of 64-bit words: up to 8192 members and more, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty(size: int) -> Column:
    """A set with room for the numbers below size."""
    return F.array_repeat(F.lit(0).cast("bigint"), -(-size // 64))


def of(numbers: Column, size: int) -> Column:
    """The set of an array of numbers below size."""
    words = F.transform(F.sequence(F.lit(0), F.lit(-(-size // 64) - 1)), lambda w: F.aggregate(F.filter(numbers, lambda x: F.floor(x / 64) == w), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(_bit(x))))
    return words


def _bit(number: Column) -> Column:
    """The word with a number's bit."""
    return F.coalesce(*[F.when(number % 64 == i, F.lit(-(1 << 63) if i == 63 else 1 << i).cast("bigint")) for i in range(64)])


def has(bits: Column, number: Column) -> Column:
    return F.coalesce(F.get(bits, F.floor(number / 64).cast("int")).bitwiseAND(_bit(number)) != 0, F.lit(False))


def union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def intersection(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def size(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda n, x: n + F.bit_count(x))


def members(bits: Column) -> Column:
    """The numbers of a set, ascending."""
    all_ = F.sequence(F.lit(0), F.size(bits) * 64 - 1)
    return F.filter(all_, lambda i: has(bits, i))
