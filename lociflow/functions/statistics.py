"""Statistics on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided normal quantiles.
QUANTILES = {95: 1.959963984540, 99: 2.575829303549}


def correlation_interval(r: Column, n: Column, percent: int) -> tuple[Column, Column]:
    """(lower, upper) of a correlation of n pairs by Fisher's z; fewer than 4 pairs count as 4."""
    half = F.lit(QUANTILES[percent]) / F.sqrt(F.greatest(n, F.lit(4)) - 3)
    z = F.atanh(r)
    return F.tanh(z - half), F.tanh(z + half)
