"""Fleet utilisation: miles and revenue per truck (Q17-Q23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import COUNT, compare_to_mean, diff_from_mean, period, ratio
from fleetlens.operators import (
    attach_one_row,
    comparison_label,
    dense_rank,
    global_totals,
    period_delta,
    sort_key,
    trailing_mean,
)
from fleetlens.plans.common import trips_with_loads
from fleetlens.plans.registry import report
from fleetlens.sources import Tables

def _has_truck():
    return F.col("truck_id").isNotNull()


def _truck_miles(t: Tables, by_month: bool = False) -> DataFrame:
    keys = ["truck_id"] + ([period("dispatch_date", "month").alias("month")] if by_month else [])
    return t.trips.where(_has_truck()).groupBy(*keys).agg(
        F.sum("actual_distance_miles").alias("total_miles")
    )


def _truck_revenue(t: Tables, by_month: bool = False) -> DataFrame:
    """Revenue per truck (per dispatch month); trips whose load is missing add null."""
    cols = ["truck_id"] + (["dispatch_date"] if by_month else [])
    joined = trips_with_loads(t, *cols, how="left").where(_has_truck())
    keys = ["truck_id"] + ([period("dispatch_date", "month").alias("month")] if by_month else [])
    name = "monthly_revenue" if by_month else "total_revenue"
    return joined.groupBy(*keys).agg(F.round(F.sum("revenue"), 2).alias(name))


@report("truck_miles", 17, "Total miles per truck")
def truck_miles(t: Tables) -> DataFrame:
    return _truck_miles(t).orderBy(sort_key("total_miles", True), "truck_id")


@report("truck_revenue", 18, "Total revenue per truck")
def truck_revenue(t: Tables) -> DataFrame:
    return _truck_revenue(t).orderBy(sort_key("total_revenue", True), "truck_id")


@report("truck_revenue_monthly", 19, "Monthly revenue per truck")
def truck_revenue_monthly(t: Tables) -> DataFrame:
    return _truck_revenue(t, by_month=True).orderBy("truck_id", F.col("month").asc_nulls_last())


@report("truck_rolling_miles", 20, "Rolling 3-month mean of miles per truck")
def truck_rolling_miles(t: Tables) -> DataFrame:
    monthly = _truck_miles(t, by_month=True)
    out = trailing_mean(monthly, ["truck_id"], "month", "total_miles", "rolling_3_month_avg_miles", 3, 2)
    return out.orderBy(F.col("truck_id").asc_nulls_last(), F.col("month").asc_nulls_last())


@report("truck_revenue_rank_monthly", 21, "Trucks ranked by revenue within each month")
def truck_revenue_rank_monthly(t: Tables) -> DataFrame:
    monthly = _truck_revenue(t, by_month=True)
    # Every truck active in a month is in that month's rank group.
    ranked = dense_rank(monthly, "monthly_revenue", "monthly_revenue_rank", ["month"])
    return ranked.orderBy(F.col("month").asc_nulls_last(), "monthly_revenue_rank", "truck_id")


@report("truck_miles_vs_fleet", 22, "Truck miles against the fleet mean")
def truck_miles_vs_fleet(t: Tables) -> DataFrame:
    per_truck = _truck_miles(t)
    fleet = global_totals(per_truck, fleet_sum=F.sum("total_miles"), fleet_n=F.count("total_miles"))
    both = attach_one_row(per_truck, fleet)
    total, s, n = F.col("total_miles"), F.col("fleet_sum"), F.col("fleet_n")
    return both.select(
        "truck_id",
        "total_miles",
        ratio(s, n, 2, den_type=COUNT).alias("fleet_avg_miles"),
        diff_from_mean(total, s, n, 2).alias("utilization_difference"),
        comparison_label(compare_to_mean(total, s, n)).alias("utilization_status"),
    ).orderBy("truck_id")


@report("truck_miles_growth", 23, "Month-over-month mileage growth per truck")
def truck_miles_growth(t: Tables) -> DataFrame:
    monthly = _truck_miles(t, by_month=True).withColumnRenamed("total_miles", "current_month_miles")
    out = period_delta(
        monthly, ["truck_id"], "month", "current_month_miles", "prev_month_miles", keep_first=False
    )
    cur, prev = F.col("current_month_miles"), F.col("prev_month_miles")
    return out.select(
        "truck_id",
        "month",
        "prev_month_miles",
        "current_month_miles",
        (cur - prev).alias("growth_miles"),
        ratio(cur - prev, prev, 2, pct=True).alias("miles_growth_pct"),
    ).orderBy(F.col("truck_id").asc_nulls_last(), F.col("month").asc_nulls_last())
