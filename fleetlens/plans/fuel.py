"""Fuel efficiency per route (Q33-Q38)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import COUNT, SMALL_AMOUNT, period, ratio
from fleetlens.functions.exact import WIDE_FIXED, fixed_quotient
from fleetlens.operators import (
    attach_one_row,
    dense_rank,
    median,
    period_delta,
    sort_key,
    trailing_mean,
)
from fleetlens.plans.common import fuel_per_trip, trips_with_loads
from fleetlens.plans.registry import report
from fleetlens.sources import Tables


def _route_mpg_sums(t: Tables, by_month: bool = False) -> DataFrame:
    """Sum and count of trip mpg per route (and dispatch month).

    For the all-time figure the trips are first summed per load, the key of
    the join to loads, so the join sees one row per load and reuses the
    aggregate's partitioning; sums and counts add up exactly. Per dispatch
    month that pre-aggregate would be keyed by (load, month), so the trips
    are joined first and aggregated once.
    """
    if not by_month:
        per_load = (
            t.for_loads().where(F.col("load_id").isNotNull())
            .groupBy("load_id")
            .agg(F.sum("average_mpg").alias("s"), F.count("average_mpg").alias("n"))
        )
        joined = per_load.join(t.loads.select("load_id", "route_id"), "load_id")
        return joined.groupBy("route_id").agg(
            F.sum("s").alias("mpg_sum"), F.sum("n").alias("mpg_n")
        )
    joined = trips_with_loads(t, "average_mpg", "dispatch_date", load_cols=("route_id",))
    return joined.groupBy("route_id", period("dispatch_date", "month").alias("month")).agg(
        F.sum("average_mpg").alias("mpg_sum"), F.count("average_mpg").alias("mpg_n")
    )


def _mean(scale: int) -> F.Column:
    return ratio(F.col("mpg_sum"), F.col("mpg_n"), scale, num_type=SMALL_AMOUNT, den_type=COUNT)


@report("route_mpg", 33, "Average MPG per route")
def route_mpg(t: Tables) -> DataFrame:
    out = _route_mpg_sums(t).select("route_id", _mean(2).alias("avg_mpg"))
    return out.orderBy(sort_key("avg_mpg", True), F.col("route_id").asc_nulls_last())


@report("route_fuel_per_mile", 34, "Fuel cost per mile per route")
def route_fuel_per_mile(t: Tables) -> DataFrame:
    # Fuel is summed per trip first; only trips with fuel count their miles.
    trips = t.trips.select("trip_id", "load_id", "actual_distance_miles")
    per_load = (
        trips.join(fuel_per_trip(t), "trip_id")
        .groupBy("load_id")
        .agg(
            F.sum("actual_distance_miles").alias("miles"),
            F.sum("trip_fuel_cost").alias("fuel"),
        )
    )
    joined = per_load.join(t.loads.select("load_id", "route_id"), "load_id")
    agg = joined.groupBy("route_id").agg(
        F.sum("miles").alias("total_miles"), F.sum("fuel").alias("fuel")
    )
    out = agg.select(
        "route_id",
        "total_miles",
        F.round("fuel", 2).alias("total_fuel_cost"),
        ratio(F.col("fuel"), F.col("total_miles"), 2).alias("cost_per_mile"),
    )
    return out.orderBy(sort_key("cost_per_mile", True), F.col("route_id").asc_nulls_last())


@report("route_mpg_mom", 35, "Month-over-month MPG per route")
def route_mpg_mom(t: Tables) -> DataFrame:
    monthly = _route_mpg_sums(t, by_month=True).select(
        "route_id", "month", fixed_quotient(F.col("mpg_sum"), F.col("mpg_n")).alias("cur")
    )
    out = period_delta(monthly, ["route_id"], "month", "cur", "prev", keep_first=False)
    out = out.select(
        "route_id",
        "month",
        F.round("prev", 2).alias("prev_month_mpg"),
        F.round("cur", 2).alias("current_month_mpg"),
        F.round(F.col("cur") - F.col("prev"), 2).alias("mpg_trend"),
    )
    return out.orderBy(F.col("route_id").asc_nulls_last(), F.col("month").asc_nulls_last())


@report("route_mpg_rank", 36, "Routes ranked by MPG")
def route_mpg_rank(t: Tables) -> DataFrame:
    routes = _route_mpg_sums(t).select("route_id", _mean(2).alias("avg_mpg"))
    ranked = dense_rank(routes, "avg_mpg", "mpg_rank")
    return ranked.orderBy(sort_key("avg_mpg", True), F.col("route_id").asc_nulls_last())


@report("route_mpg_below_median", 37, "Routes with MPG below the median route")
def route_mpg_below_median(t: Tables) -> DataFrame:
    routes = _route_mpg_sums(t).withColumn(
        "mpg_d", F.col("mpg_sum").cast("double") / F.nullif(F.col("mpg_n"), F.lit(0))
    )
    # Interpolated median over one value per route, exact.
    both = attach_one_row(routes, median(routes, "mpg_d", "median_d"))
    below = both.where(F.col("mpg_d") < F.col("median_d")).orderBy(sort_key("mpg_d", True), F.col("route_id").asc_nulls_last())
    return below.select(
        "route_id",
        _mean(4).alias("avg_mpg"),
        F.round(F.col("median_d"), 4).alias("fleet_median"),
    )


@report("route_rolling_mpg", 38, "Rolling 3-month MPG per route")
def route_rolling_mpg(t: Tables) -> DataFrame:
    monthly = _route_mpg_sums(t, by_month=True).select(
        "route_id",
        "month",
        _mean(4).alias("avg_mpg"),
        fixed_quotient(F.col("mpg_sum"), F.col("mpg_n")).alias("fixed_mpg"),
    )
    out = trailing_mean(
        monthly, ["route_id"], "month", "fixed_mpg", "rolling_avg_mpg", 3, 4, num_type=WIDE_FIXED
    )
    out = out.select("route_id", "month", "avg_mpg", "rolling_avg_mpg")
    return out.orderBy(F.col("route_id").asc_nulls_last(), F.col("month").asc_nulls_last())
