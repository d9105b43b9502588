"""Exact half-away-from-zero rounding of ratios of integers.

Engines disagree on rounding doubles (``round(1.005, 2)`` is 1.01 in one and
1.0 in another).  Every published ratio here is built from integer numerator
and denominator, so the digits never depend on the engine or on the order in
which partial sums arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WIDE = "decimal(27,0)"


def scaled_ratio(num: Column, den: Column, digits: int) -> Column:
    """``num/den * 10^digits`` as a bigint, half away from zero; NULL if den is 0."""
    n = num.cast(_WIDE)
    d = F.nullif(den.cast(_WIDE), F.lit(0).cast(_WIDE))
    twice = F.abs(n) * F.lit(2 * 10**digits).cast("decimal(10,0)")
    magnitude = F.call_function("div", twice + d, d * F.lit(2).cast("decimal(1,0)"))
    return F.when(n < 0, -magnitude).otherwise(magnitude)


def rounded_ratio(num: Column, den: Column, digits: int) -> Column:
    """``num/den`` rounded to ``digits`` decimals as a double; NULL if den is 0."""
    return scaled_ratio(num, den, digits).cast("double") / F.lit(float(10**digits))


def hundredths(col: Column) -> Column:
    """A two-decimal value as an exact bigint count of hundredths."""
    return (col.cast("decimal(20,2)") * F.lit(100).cast("decimal(3,0)")).cast("bigint")
