"""Exact ratios of integers, rounded half to even.

Decimal division rounds to a fixed scale first and would round twice, so the
quotient and remainder are taken as integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def round_half_even(n: Column, d: Column) -> Column:
    """n / d as a bigint, ties to the even neighbour; null where d is 0.  d is positive."""
    n, d = _wide(n), _wide(F.when(d != 0, d))
    rest = F.pmod(n, d)
    whole = _wide((n - rest) / d)
    up = F.when(2 * rest > d, 1).when((2 * rest == d) & (F.pmod(whole, F.lit(2)) == 1), 1).otherwise(0)
    return (whole + up).cast("bigint")


def tenths_text(tenths: Column) -> Column:
    """-123 as "-12.3"."""
    size = F.abs(tenths)
    sign = F.when(tenths < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, ((size - size % 10) / 10).cast("bigint").cast("string"), F.lit("."), (size % 10).cast("string"))


def percent(part: Column, base: Column) -> Column:
    """100 * part / base to one decimal as text, null where base is 0; a negative base flips both signs."""
    flip = F.when(base < 0, -1).otherwise(1)
    return tenths_text(round_half_even(part * 1000 * flip, base * flip))
