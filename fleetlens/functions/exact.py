"""Exact decimal ratios and means.

The reports round money, miles and mpg with decimal semantics (half away from
zero). Spark's ``avg`` on a decimal stops at scale + 4 and ``/`` picks a result
scale from the operand precisions, so a naive expression can round twice. The
helpers below cast operands to widths that leave the quotient at least seven
digits beyond the requested scale before the single final ``round``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Operand types. Twenty integer digits hold any sum of money or miles at
# cluster scale (1e18); the quotient then keeps 10 to 24 fractional digits.
AMOUNT = DecimalType(22, 2)
COUNT = DecimalType(20, 0)
SMALL_AMOUNT = DecimalType(16, 2)  # sums of mpg: leaves 23 fractional digits
FIXED = DecimalType(28, 16)  # fixed-point mean reused by a later mean or difference
WIDE_FIXED = DecimalType(30, 16)


def ratio(
    num: Column,
    den: Column,
    scale: int,
    *,
    pct: bool = False,
    num_type: DecimalType = AMOUNT,
    den_type: DecimalType = AMOUNT,
) -> Column:
    """``round(num / den, scale)`` (times 100 first when ``pct``), exact in decimal.

    Null when ``den`` is zero or null: every division in the reports is either
    guarded by ``NULLIF(den, 0)`` or is a divisor that cannot be zero on valid
    data; returning null keeps a whole job from failing on one bad group.
    """
    n = num.cast(num_type)
    if pct:
        n = n * F.lit(100).cast(DecimalType(3, 0))
    d = den.cast(den_type)
    return F.round(n / F.nullif(d, F.lit(0).cast(den_type)), scale)


def mean(col: Column | str, scale: int, *, num_type: DecimalType = AMOUNT) -> Column:
    """Aggregate: exact average of a decimal column rounded to ``scale`` (nulls ignored)."""
    c = F.col(col) if isinstance(col, str) else col
    return ratio(F.sum(c), F.count(c), scale, num_type=num_type, den_type=COUNT)


def fixed_quotient(total: Column, count: Column, *, num_type: DecimalType = SMALL_AMOUNT) -> Column:
    """``total / count`` as a 16-digit fixed-point decimal(28,16).

    Used where a mean feeds another mean or a difference before its final
    rounding, so both engines start the second step from the same value.
    """
    return ratio(total, count, 16, num_type=num_type, den_type=COUNT).cast(FIXED)


def diff_from_mean(value: Column, total: Column, count: Column, scale: int) -> Column:
    """``round(value - total / count, scale)`` without rounding the mean first.

    Rewritten as ``(value * count - total) / count`` so it is one exact division.
    """
    return ratio(value * count - total, count, scale, num_type=DecimalType(30, 2), den_type=COUNT)


def compare_to_mean(value: Column, total: Column, count: Column) -> Column:
    """Sign of ``value - total / count`` as -1, 0, 1 (null if any input is null)."""
    scaled = value * count
    return F.when(scaled > total, 1).when(scaled < total, -1).when(scaled == total, 0)
