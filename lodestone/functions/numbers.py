"""Rounding as of the binary value: what a double is nearest to, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_binary(x: Column, places: int) -> Column:
    """A double to at most 6 places, by its exact value. ``round`` goes by the shortest decimal that names it, which differs only where that is a tie.

    There the exact value and the tie are compared as whole numbers: both times a power of two that leaves the double no fraction. Magnitudes
    from 2^-20 to 2^30 are told so; for others ties are rounded half to even as they are named.
    """
    size = F.when(F.abs(x).between(2.0**-20, 2.0**30), F.abs(x))
    tens = F.lit(10 ** (places + 1)).cast("decimal(8,0)")
    scaled = size.cast("decimal(28,16)") * tens
    whole = F.floor(scaled).cast("decimal(18,0)")
    shift = F.lit(52) - F.floor(F.log2(size))
    # Powers and products below 2^53 are exact, and so are their decimals.
    power = lambda n: F.pow(F.lit(2.0), n).cast("decimal(12,0)")
    exact = (size * F.pow(F.lit(2.0), shift)).cast("decimal(18,1)") * tens
    tie = whole * (power(F.least(shift, F.lit(36))) * power(F.greatest(shift - 36, F.lit(0))))
    low = F.floor(whole / 10).cast("double")
    up = (exact > tie) | ((exact == tie) & (low % 2 == 1))
    is_tie = (scaled == whole) & (whole % 10 == 5)
    return F.when(is_tie, F.signum(x) * F.when(up, low + 1).otherwise(low) / 10.0**places).otherwise(F.bround(x, places))
