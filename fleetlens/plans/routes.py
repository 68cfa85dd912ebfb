"""Route profitability: revenue, fuel cost, profit over time (Q09-Q16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import in_period, period, ratio
from fleetlens.operators import (
    attach_one_row,
    comparison_label,
    consecutive_rise,
    global_totals,
    holders_of_max,
    latest_period_start,
    period_delta,
    sort_key,
    top_dense_rank,
)
from fleetlens.plans.common import fuel_per_trip
from fleetlens.plans.registry import report
from fleetlens.sources import Tables


def route_fuel(t: Tables, unit: str | None = None) -> DataFrame:
    """Fuel cost per route (and per dispatch period when ``unit`` is given).

    Fuel is summed per trip (the join key) before it meets the trips. For the
    all-time total the trip results are summed again per load, again the key
    of the next join, so each shuffle carries one row per key and the
    aggregate's partitioning is reused by the join. With a period the load
    pre-aggregation would be keyed by (load, period) and need its own
    shuffle, so the loads are joined first and aggregated once.
    """
    if unit is None:
        trips = t.trips.select("trip_id", "load_id")
        per_load = (
            trips.join(fuel_per_trip(t), "trip_id")
            .groupBy("load_id")
            .agg(F.sum("trip_fuel_cost").alias("fuel"))
        )
        joined = per_load.join(t.loads.select("load_id", "route_id"), "load_id")
        return joined.groupBy("route_id").agg(F.sum("fuel").alias("fuel_cost"))
    trips = t.trips.select("trip_id", "load_id", period("dispatch_date", unit).alias(unit))
    joined = trips.join(fuel_per_trip(t), "trip_id").join(
        t.loads.select("load_id", "route_id"), "load_id"
    )
    return joined.groupBy("route_id", unit).agg(F.sum("trip_fuel_cost").alias("fuel_cost"))


def route_period_profit(t: Tables, unit: str) -> DataFrame:
    """Net profit per (route, dispatch period): revenue counted once per trip, minus fuel.

    One pass instead of two aggregates and a join: trips are left-joined to
    their summed fuel and to their load, then aggregated once per (route,
    period). A (route, period) with no fuel gets 0, and so does one whose
    route or period is null (a null key never matches in the two-aggregate
    form).
    """
    trips = t.trips.select("trip_id", "load_id", period("dispatch_date", unit).alias(unit))
    joined = trips.join(fuel_per_trip(t), "trip_id", "left").join(
        t.loads.select("load_id", "route_id", "revenue"), "load_id"
    )
    agg = joined.groupBy("route_id", unit).agg(
        F.sum("revenue").alias("total_revenue"),
        F.sum("trip_fuel_cost").alias("fuel_cost"),
    )
    fuel = F.when(
        F.col("route_id").isNotNull() & F.col(unit).isNotNull(),
        F.coalesce(F.col("fuel_cost"), F.lit(0)),
    ).otherwise(F.lit(0))
    return agg.select("route_id", unit, F.round(F.col("total_revenue") - fuel, 2).alias("net_profit"))


def route_profit(t: Tables) -> DataFrame:
    """All-time revenue (every load, with or without trips) minus fuel, per route."""
    revenue = t.loads.groupBy("route_id").agg(F.sum("revenue").alias("rev"))
    joined = revenue.join(route_fuel(t), "route_id", "left")
    fuel = F.coalesce(F.col("fuel_cost"), F.lit(0))
    return joined.select(
        "route_id",
        F.round("rev", 2).alias("total_revenue"),
        F.round(fuel, 2).alias("total_fuel_cost"),
        F.round(F.col("rev") - fuel, 2).alias("net_profit"),
    )


@report("route_revenue", 9, "Total revenue per route")
def route_revenue(t: Tables) -> DataFrame:
    agg = t.loads.groupBy("route_id").agg(F.round(F.sum("revenue"), 2).alias("total_revenue"))
    return agg.orderBy(sort_key("total_revenue", True), F.col("route_id").asc_nulls_last())


@report("route_fuel_cost", 10, "Total fuel cost per route")
def route_fuel_cost(t: Tables) -> DataFrame:
    out = route_fuel(t).select("route_id", F.round("fuel_cost", 2).alias("total_fuel_cost"))
    return out.orderBy(sort_key("total_fuel_cost", True), F.col("route_id").asc_nulls_last())


@report("route_net_profit", 11, "Net profit (revenue - fuel) per route")
def route_net_profit(t: Tables) -> DataFrame:
    return route_profit(t).orderBy(sort_key("net_profit", True), F.col("route_id").asc_nulls_last())


@report("route_profit_mom", 12, "Monthly profit trend per route")
def route_profit_mom(t: Tables) -> DataFrame:
    monthly = route_period_profit(t, "month")
    out = period_delta(
        monthly, ["route_id"], "month", "net_profit",
        "previous_month_profit", "profit_trend", keep_first=True, change_scale=2,
    )
    out = out.select("route_id", "month", "previous_month_profit", "net_profit", "profit_trend")
    return out.orderBy(F.col("route_id").asc_nulls_last(), F.col("month").asc_nulls_last())


@report("route_top5_quarter", 13, "Top 5 routes by profit in each quarter")
def route_top5_quarter(t: Tables) -> DataFrame:
    quarterly = route_period_profit(t, "quarter")
    top = top_dense_rank(quarterly, "net_profit", "rank_in_quarter", 5, ["quarter"])
    return top.orderBy(F.col("quarter").asc_nulls_last(), "rank_in_quarter", F.col("route_id").asc_nulls_last())


@report("route_rising_fuel", 14, "Routes whose fuel cost rose over the last 3 months")
def route_rising_fuel(t: Tables) -> DataFrame:
    monthly = route_fuel(t, "month")
    rising = consecutive_rise(
        monthly, ["route_id"], "month", "fuel_cost",
        ["prev_month_cost", "prev_2_month_cost"], months=2,
    )
    out = rising.select("route_id", "month", "fuel_cost", "prev_month_cost", "prev_2_month_cost")
    return out.orderBy(F.col("route_id").asc_nulls_last(), F.col("month").asc_nulls_last())


@report("route_profit_vs_company", 15, "Route profit against the company average")
def route_profit_vs_company(t: Tables) -> DataFrame:
    profit = route_profit(t)
    company = global_totals(profit, _sum=F.sum("net_profit"), _n=F.count("net_profit"))
    both = attach_one_row(profit, company.select(ratio(F.col("_sum"), F.col("_n"), 2).alias("company_average")))
    diff = F.col("net_profit") - F.col("company_average")
    sign = F.when(diff > 0, 1).when(diff < 0, -1).when(diff == 0, 0)
    out = both.select(
        "route_id",
        "net_profit",
        "company_average",
        F.round(diff, 2).alias("difference"),
        comparison_label(sign).alias("difference_status"),
    )
    return out.orderBy(F.col("route_id").asc_nulls_last())


@report("route_top_revenue_latest_month", 16, "Route(s) with the highest revenue in the latest month")
def route_top_revenue_latest_month(t: Tables) -> DataFrame:
    start = latest_period_start(t.dated("trips"), "dispatch_date", "month")
    recent = t.trips.where(in_period("dispatch_date", start, "month")).select(
        "load_id", period("dispatch_date", "month").alias("month")
    )
    joined = recent.join(t.loads.select("load_id", "route_id", "revenue"), "load_id")
    monthly = joined.groupBy("route_id", "month").agg(F.sum("revenue").alias("total_revenue"))
    return holders_of_max(monthly, "total_revenue").select(
        "route_id", "month", "total_revenue"
    )
