"""Maintenance cost and downtime per truck (Q24-Q32)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import COUNT, in_period, period, ratio
from fleetlens.operators import (
    inactive_members,
    latest_period_start,
    period_delta,
    since_months_before_latest,
    sort_key,
    top_dense_rank,
    with_previous,
)
from fleetlens.plans.common import trips_with_loads
from fleetlens.plans.registry import report
from fleetlens.sources import Tables


def _month(col: str) -> F.Column:
    return period(col, "month")


@report("truck_maintenance_cost", 24, "Total maintenance cost per truck")
def truck_maintenance_cost(t: Tables) -> DataFrame:
    agg = t.maintenance_records.groupBy("truck_id").agg(
        F.round(F.sum("total_cost"), 2).alias("total_maintenance_cost")
    )
    return agg.orderBy(sort_key("total_maintenance_cost", True), F.col("truck_id").asc_nulls_last())


@report("truck_downtime", 25, "Total downtime hours per truck")
def truck_downtime(t: Tables) -> DataFrame:
    agg = t.maintenance_records.groupBy("truck_id").agg(
        F.round(F.sum("downtime_hours"), 2).alias("total_downtime_hours")
    )
    return agg.orderBy(sort_key("total_downtime_hours", True), F.col("truck_id").asc_nulls_last())


@report("truck_maintenance_per_mile", 26, "Maintenance cost per mile driven")
def truck_maintenance_per_mile(t: Tables) -> DataFrame:
    # Both sides are aggregated to one row per truck before the join.
    miles = t.trips.groupBy("truck_id").agg(F.sum("actual_distance_miles").alias("total_miles"))
    cost = t.maintenance_records.groupBy("truck_id").agg(F.sum("total_cost").alias("cost"))
    joined = miles.join(cost, "truck_id")
    return joined.select(
        "truck_id",
        "total_miles",
        F.round("cost", 2).alias("total_maintenance_cost"),
        ratio(F.col("cost"), F.col("total_miles"), 4).alias("cost_per_mile"),
    ).orderBy(sort_key("cost_per_mile", True), F.col("truck_id").asc_nulls_last())


@report("truck_maintenance_mom", 27, "Month-over-month maintenance cost per truck")
def truck_maintenance_mom(t: Tables) -> DataFrame:
    monthly = t.maintenance_records.groupBy(
        "truck_id", _month("maintenance_date").alias("month")
    ).agg(F.sum("total_cost").alias("cur"))
    out = period_delta(monthly, ["truck_id"], "month", "cur", "prev", keep_first=False)
    return out.select(
        "truck_id",
        "month",
        F.round("prev", 2).alias("prev_month_cost"),
        F.round("cur", 2).alias("current_month_cost"),
        F.round(F.col("cur") - F.col("prev"), 2).alias("monthly_cost_trend"),
    ).orderBy(F.col("truck_id").asc_nulls_last(), F.col("month").asc_nulls_last())


@report("maintenance_horizon", 28, "Latest maintenance date")
def maintenance_horizon(t: Tables) -> DataFrame:
    return t.dated("maintenance_records").agg(F.max("maintenance_date").alias("max_maintenance_date"))


@report("truck_top5_downtime_6m", 29, "Top 5 trucks by downtime in the last 6 months")
def truck_top5_downtime_6m(t: Tables) -> DataFrame:
    recent = since_months_before_latest(t.maintenance_records, "maintenance_date", 6, t.dated("maintenance_records"))
    per_truck = recent.groupBy("truck_id").agg(F.sum("downtime_hours").alias("raw_downtime"))
    # Ranked on the unrounded sum, reported rounded.
    top = top_dense_rank(per_truck, "raw_downtime", "downtime_rank", 5)
    return top.select(
        "truck_id", F.round("raw_downtime", 2).alias("total_downtime"), "downtime_rank"
    ).orderBy(sort_key("total_downtime", True), F.col("truck_id").asc_nulls_last())


@report("truck_downtime_vs_trips", 30, "Monthly downtime against monthly trip count per truck")
def truck_downtime_vs_trips(t: Tables) -> DataFrame:
    downtime = t.maintenance_records.groupBy(
        "truck_id", _month("maintenance_date").alias("operational_month")
    ).agg(F.sum("downtime_hours").alias("cur_down"))
    trips = t.trips.groupBy("truck_id", _month("dispatch_date").alias("operational_month")).agg(
        F.count("trip_id").alias("current_month_trips")
    )
    # Both sides are one row per (truck, month); lags run over the joined months only.
    joined = downtime.join(trips, ["truck_id", "operational_month"])
    lagged = with_previous(
        joined, ["truck_id"], "operational_month",
        {"prev_down": ("cur_down", 1), "prev_month_trips": ("current_month_trips", 1)},
    )
    cur_d, prev_d = F.col("cur_down"), F.col("prev_down")
    return lagged.select(
        "truck_id",
        "operational_month",
        F.round(prev_d, 2).alias("prev_month_downtime"),
        F.round(cur_d, 2).alias("current_month_downtime"),
        F.round(cur_d - prev_d, 2).alias("downtime_change"),
        "prev_month_trips",
        "current_month_trips",
        (F.col("current_month_trips") - F.col("prev_month_trips")).alias("trips_change"),
        ratio(cur_d, F.col("current_month_trips"), 2, den_type=COUNT).alias("downtime_per_trip"),
    ).orderBy(F.col("truck_id").asc_nulls_last(), F.col("operational_month").asc_nulls_last())


@report("truck_maintenance_vs_revenue", 31, "Maintenance cost against revenue per truck")
def truck_maintenance_vs_revenue(t: Tables) -> DataFrame:
    cost = t.maintenance_records.groupBy("truck_id").agg(F.sum("total_cost").alias("cost"))
    revenue = trips_with_loads(t, "truck_id").groupBy("truck_id").agg(F.sum("revenue").alias("rev"))
    joined = cost.join(revenue, "truck_id")
    return joined.select(
        "truck_id",
        F.round("rev", 2).alias("total_revenue"),
        F.round("cost", 2).alias("total_maintenance_cost"),
        F.round(F.col("rev") - F.col("cost"), 2).alias("net_operational_profit"),
    ).orderBy(sort_key("net_operational_profit", True), F.col("truck_id").asc_nulls_last())


@report("truck_zero_downtime_quarter", 32, "Trucks with no downtime in the latest quarter")
def truck_zero_downtime_quarter(t: Tables) -> DataFrame:
    m = t.maintenance_records
    start = latest_period_start(t.dated("maintenance_records"), "maintenance_date", "quarter")
    quarter_downtime = (
        m.where(in_period("maintenance_date", start, "quarter"))
        .groupBy("truck_id")
        .agg(F.sum("downtime_hours").alias("total_downtime"))
    )
    return inactive_members(t.trucks, quarter_downtime, "truck_id", "total_downtime").orderBy(
        "truck_id"
    )
