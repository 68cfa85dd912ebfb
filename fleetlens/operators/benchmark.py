"""Comparison with a one-row benchmark (B8) and share of a total (B9).

The benchmark is a global aggregate: exactly one row, so broadcasting it is
safe at any input size. Both sides are aggregated before the cross join; the
cross join only attaches that one row to each result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.exact import ratio

# Labels of the comparison with an average.
ABOVE = "Above Average"
BELOW = "Below Average"
EQUAL = "Equal to Average"


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a single-row DataFrame (a global aggregate) to every row."""
    return df.crossJoin(F.broadcast(one_row))


def comparison_label(sign: Column) -> Column:
    """Label for the sign of (value - benchmark); a null comparison counts as equal."""
    return F.when(sign > 0, F.lit(ABOVE)).when(sign < 0, F.lit(BELOW)).otherwise(F.lit(EQUAL))


def global_totals(df: DataFrame, **aggs: Column) -> DataFrame:
    """One-row DataFrame of named global aggregates (partial + final aggregate)."""
    return df.agg(*[expr.alias(name) for name, expr in aggs.items()])


def share_of_total(
    df: DataFrame,
    measure: str,
    total_name: str,
    share_name: str,
    scale: int = 2,
    *,
    bounded: bool = False,
) -> DataFrame:
    """Add the grand total of ``measure`` and each row's percentage of it.

    The total is the sum of the rows themselves (they are already aggregated,
    so no second scan of the facts). ``bounded=True`` (a handful of rows,
    e.g. seasons) takes it with an unpartitioned window; otherwise it is a
    one-row global aggregate attached by a broadcast cross join. The share is
    ``100 * measure / total`` rounded once, null for a zero total. The total
    column holds the unrounded sum.
    """
    if bounded:
        with_total = df.withColumn(total_name, F.sum(measure).over(Window.partitionBy()))
    else:
        with_total = attach_one_row(df, global_totals(df, **{total_name: F.sum(measure)}))
    share = ratio(F.col(measure), F.col(total_name), scale, pct=True)
    return with_total.withColumn(share_name, share)
