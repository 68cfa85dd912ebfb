"""Latest-period selection, trailing horizons and members without activity (B10, B13, B15).

The horizon (the latest date or period) is one scalar, computed as a scalar
subquery. Spark runs it as its own small job and then applies the resulting
range predicate in the scan, where parquet min/max statistics can skip row
groups; the facts are filtered before any join or aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.calendar import in_period, period


def latest_value(df: DataFrame, col: str) -> Column:
    """Scalar-subquery column: ``max(col)`` over ``df``."""
    return df.agg(F.max(col)).scalar()


def latest_period_start(df: DataFrame, date_col: str, unit: str) -> Column:
    """Scalar-subquery column: first day of the period holding ``max(date_col)``."""
    return df.agg(period(F.max(date_col), unit)).scalar()


def in_latest_period(df: DataFrame, date_col: str, unit: str, horizon_df: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` dated in the latest period of ``horizon_df`` (default ``df``)."""
    start = latest_period_start(horizon_df if horizon_df is not None else df, date_col, unit)
    return df.where(in_period(date_col, start, unit))


def since_months_before_latest(
    df: DataFrame, date_col: str, months: int, horizon_df: DataFrame | None = None
) -> DataFrame:
    """Rows dated on or after ``max(date_col) - months`` of ``horizon_df`` (default ``df``; inclusive, month-end clamped)."""
    start = (horizon_df if horizon_df is not None else df).agg(F.add_months(F.max(date_col), -months)).scalar()
    return df.where(F.col(date_col) >= start)


def holders_of_max(df: DataFrame, measure: str) -> DataFrame:
    """All rows whose ``measure`` equals the maximum, a scalar subquery (ties kept; none if all null)."""
    return df.where(F.col(measure) == latest_value(df, measure))


def inactive_members(
    members: DataFrame, activity: DataFrame, key: str, measure: str
) -> DataFrame:
    """Members whose summed activity is zero or who have no activity row.

    A left join plus ``coalesce(measure, 0) = 0``: an anti join alone would
    miss members whose recorded activity sums to zero.
    """
    return (
        members.join(activity, key, "left")
        .where(F.coalesce(F.col(measure), F.lit(0)) == 0)
        .select(key, F.coalesce(F.col(measure), F.lit(0)).alias(measure))
    )
