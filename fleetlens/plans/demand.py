"""Seasonal demand: load and trip volumes and revenue over the calendar (Q52-Q59).

Every report here aggregates to one row per month, quarter or season first;
the unpartitioned windows that follow run over that bounded series only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import month_label, period, quarter_label_of, season
from fleetlens.operators import period_delta, present, share_of_total, sort_key, top_dense_rank
from fleetlens.plans.registry import report
from fleetlens.sources import Tables


def _monthly_loads(t: Tables, count_name: str) -> DataFrame:
    return t.loads.groupBy(period("load_date", "month").alias("m")).agg(
        F.count("load_id").alias(count_name)
    )


def _chronological(df: DataFrame, *cols) -> DataFrame:
    """Sort by the month date, then replace it by its text label."""
    return present(df, F.col("m").asc_nulls_last(), bounded=True).select(
        month_label("m").alias("month"), *cols
    )


@report("load_volume_monthly", 52, "Monthly load volume")
def load_volume_monthly(t: Tables) -> DataFrame:
    monthly = t.loads.groupBy(period("load_date", "month").alias("m")).agg(
        F.count(F.lit(1)).alias("load_volume")
    )
    return _chronological(monthly, "load_volume")


@report("revenue_mom", 53, "Monthly revenue trend")
def revenue_mom(t: Tables) -> DataFrame:
    monthly = t.loads.groupBy(period("load_date", "month").alias("m")).agg(
        F.sum("revenue").alias("cur")
    )
    out = period_delta(monthly, [], "m", "cur", "prev", keep_first=True)
    return _chronological(
        out,
        F.round("prev", 2).alias("previous_month_revenue"),
        F.round("cur", 2).alias("current_month_revenue"),
        F.round(F.col("cur") - F.col("prev"), 2).alias("monthly_revenue_trend"),
    )


@report("trip_volume_monthly", 54, "Monthly trip volume")
def trip_volume_monthly(t: Tables) -> DataFrame:
    monthly = t.trips.groupBy(period("dispatch_date", "month").alias("m")).agg(
        F.count(F.lit(1)).alias("trip_volume")
    )
    return _chronological(monthly, "trip_volume")


@report("load_volume_quarterly", 55, "Quarterly load volume")
def load_volume_quarterly(t: Tables) -> DataFrame:
    q = t.loads.groupBy(
        F.year("load_date").alias("y"), F.quarter("load_date").alias("q")
    ).agg(F.count(F.lit(1)).alias("load_volume"))
    return present(q, F.col("y").asc_nulls_last(), F.col("q").asc_nulls_last(), bounded=True).select(
        quarter_label_of(F.col("y"), F.col("q")).alias("quarter"), "load_volume"
    )


@report("load_volume_mom", 56, "Month-over-month load growth")
def load_volume_mom(t: Tables) -> DataFrame:
    monthly = _monthly_loads(t, "current_month_load")
    out = period_delta(
        monthly, [], "m", "current_month_load", "previous_month_load",
        "monthly_load_growth", keep_first=True,
    )
    return _chronological(out, "previous_month_load", "current_month_load", "monthly_load_growth")


def _peak_months(t: Tables, count_name: str, rank_name: str) -> DataFrame:
    monthly = _monthly_loads(t, count_name)
    top = top_dense_rank(monthly, count_name, rank_name, 1)
    return present(top, F.col("m").asc_nulls_last(), bounded=True).select(
        month_label("m").alias("load_month"), count_name, rank_name
    )


@report("peak_load_month", 57, "Peak shipment month")
def peak_load_month(t: Tables) -> DataFrame:
    return _peak_months(t, "total_monthly_load", "month_rank")


@report("season_revenue_share", 58, "Revenue contribution by season")
def season_revenue_share(t: Tables) -> DataFrame:
    seasonal = t.loads.groupBy(season("load_date").alias("season")).agg(
        F.sum("revenue").alias("seasonal")
    )
    # Every load falls in exactly one season (or Unknown), so the grand total
    # is the sum of the at most six season rows: no second scan of loads.
    shares = share_of_total(
        seasonal, "seasonal", "total", "seasonal_revenue_contribution", bounded=True
    )
    out = shares.select(
        "season",
        F.round("seasonal", 2).alias("seasonal_revenue"),
        F.round("total", 2).alias("total_revenue"),
        "seasonal_revenue_contribution",
    )
    return present(out, sort_key("seasonal_revenue_contribution", True), "season", bounded=True)


@report("busiest_load_month", 59, "Month with the highest load volume")
def busiest_load_month(t: Tables) -> DataFrame:
    return _peak_months(t, "load_volume", "load_rank")

