"""Driver performance: punctuality, fuel economy, revenue per mile (Q01-Q08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import COUNT, SMALL_AMOUNT, mean, period, ratio
from fleetlens.functions.exact import fixed_quotient
from fleetlens.operators import (
    attach_one_row,
    dense_rank_of_few,
    first_ntile,
    global_totals,
    in_latest_period,
    period_delta,
    sort_key,
)
from fleetlens.plans.common import trips_with_loads
from fleetlens.plans.registry import report
from fleetlens.sources import Tables


def _events_per_trip(t: Tables) -> DataFrame:
    """Delivery counts per trip before the join to trips.

    Counts add up, so counting per trip first is exact; the aggregate is
    partitioned on ``trip_id``, which the join reuses.
    """
    return t.delivery_events.groupBy("trip_id").agg(
        F.count("event_id").alias("n_events"),
        F.count(F.when(F.col("on_time_flag"), F.lit(1))).alias("n_on_time"),
    )


def _on_time_rate() -> F.Column:
    return ratio(
        F.col("on_time_deliveries"), F.col("total_deliveries"), 2,
        pct=True, num_type=COUNT, den_type=COUNT,
    )


@report("driver_on_time", 1, "On-time delivery rate per driver")
def driver_on_time(t: Tables) -> DataFrame:
    per_trip = _events_per_trip(t)
    joined = t.trips.select("trip_id", "driver_id").join(per_trip, "trip_id")
    agg = joined.groupBy("driver_id").agg(
        F.sum("n_events").alias("total_deliveries"),
        F.sum("n_on_time").alias("on_time_deliveries"),
    )
    return agg.withColumn("on_time_delivery_rate", _on_time_rate()).orderBy(
        sort_key("on_time_delivery_rate", True), F.col("driver_id").asc_nulls_last()
    )


@report("driver_mpg", 2, "Average fuel efficiency per driver")
def driver_mpg(t: Tables) -> DataFrame:
    agg = t.trips.groupBy("driver_id").agg(
        F.count("trip_id").alias("total_trips"),
        mean("average_mpg", 2, num_type=SMALL_AMOUNT).alias("avg_driver_mpg"),
    )
    return agg.orderBy(sort_key("avg_driver_mpg", True), F.col("driver_id").asc_nulls_last())


@report("driver_revenue_per_mile", 3, "Revenue per mile per driver")
def driver_revenue_per_mile(t: Tables) -> DataFrame:
    joined = trips_with_loads(t, "driver_id", "actual_distance_miles")
    agg = joined.groupBy("driver_id").agg(
        F.sum("actual_distance_miles").alias("total_distance"),
        F.sum("revenue").alias("total_revenue"),
    )
    return agg.withColumn(
        "revenue_per_mile", ratio(F.col("total_revenue"), F.col("total_distance"), 2)
    ).orderBy(sort_key("revenue_per_mile", True), F.col("driver_id").asc_nulls_last())


@report("driver_monthly_on_time_rank", 4, "Drivers ranked by on-time rate within each month")
def driver_monthly_on_time_rank(t: Tables) -> DataFrame:
    # Grouped by (driver, event month): a per-trip pre-aggregate would be keyed
    # by (trip, month) and need a shuffle of its own, so join first.
    events = t.delivery_events.select(
        "trip_id", "event_id", "on_time_flag", period("actual_date", "month").alias("month")
    )
    joined = t.trips.select("trip_id", "driver_id").join(events, "trip_id")
    monthly = joined.groupBy("driver_id", "month").agg(
        F.count("event_id").alias("total_deliveries"),
        F.count(F.when(F.col("on_time_flag"), F.lit(1))).alias("on_time_deliveries"),
    ).withColumn("on_time_delivery_rate", _on_time_rate())
    # All drivers of a month form one rank group, which grows with the fleet.
    # Their rates have two digits, so few of them differ.
    ranked = dense_rank_of_few(monthly, "on_time_delivery_rate", "monthly_rank", ["month"])
    return ranked.orderBy(F.col("month").asc_nulls_last(), "monthly_rank", F.col("driver_id").asc_nulls_last())


@report("driver_top_decile", 5, "Top 10% of drivers by revenue per mile")
def driver_top_decile(t: Tables) -> DataFrame:
    joined = trips_with_loads(t, "driver_id", "actual_distance_miles")
    agg = joined.groupBy("driver_id").agg(
        F.sum("actual_distance_miles").alias("miles"), F.sum("revenue").alias("rev")
    )
    drivers = agg.select(
        "driver_id",
        F.round("miles", 2).alias("total_distance_miles"),
        F.round("rev", 2).alias("total_revenue"),
        ratio(F.col("rev"), F.col("miles"), 2).alias("revenue_per_mile"),
    )
    # Ties on the measure are broken by driver id so the cut is deterministic.
    order = [sort_key("revenue_per_mile", True), F.col("driver_id").asc_nulls_last()]
    top = first_ntile(drivers, "revenue_per_mile", "driver_id", 10, "revenue_bucket")
    return top.orderBy(*order)


@report("driver_mpg_vs_fleet", 6, "Driver MPG against the fleet average")
def driver_mpg_vs_fleet(t: Tables) -> DataFrame:
    per_driver = t.trips.groupBy("driver_id").agg(
        F.sum("average_mpg").alias("d_sum"), F.count("average_mpg").alias("d_n")
    )
    # The fleet mean is over all trips, not over the driver means. Sums and
    # counts add up, so it is taken from the per-driver rows (null driver
    # included) instead of a second scan of the trips.
    fleet = global_totals(per_driver, f_sum=F.sum("d_sum"), f_n=F.sum("d_n"))
    both = attach_one_row(per_driver, fleet)
    d_sum, d_n, f_sum, f_n = (F.col(c) for c in ("d_sum", "d_n", "f_sum", "f_n"))
    out = both.select(
        "driver_id",
        ratio(d_sum, d_n, 2, num_type=SMALL_AMOUNT, den_type=COUNT).alias("driver_avg_mpg"),
        ratio(f_sum, f_n, 2, num_type=SMALL_AMOUNT, den_type=COUNT).alias("fleet_avg_mpg"),
        F.round(fixed_quotient(d_sum, d_n) - fixed_quotient(f_sum, f_n), 2).alias("mpg_difference"),
    )
    return out.orderBy(sort_key("mpg_difference", True), F.col("driver_id").asc_nulls_last())


@report("driver_revenue_mom", 7, "Month-over-month revenue per driver")
def driver_revenue_mom(t: Tables) -> DataFrame:
    joined = trips_with_loads(t, "driver_id", "dispatch_date")
    monthly = joined.groupBy("driver_id", period("dispatch_date", "month").alias("month")).agg(
        F.round(F.sum("revenue"), 2).alias("monthly_revenue")
    )
    out = period_delta(
        monthly, ["driver_id"], "month", "monthly_revenue",
        "previous_month_revenue", "revenue_trend", keep_first=True, change_scale=2,
    )
    return out.orderBy(F.col("driver_id").asc_nulls_last(), F.col("month").asc_nulls_last())


@report("driver_best_mpg_latest_month", 8, "Driver with the best MPG in the latest month")
def driver_best_mpg_latest_month(t: Tables) -> DataFrame:
    # The latest month is found first and applied to the scan, so only that
    # month's trips are aggregated.
    recent = in_latest_period(t.trips, "dispatch_date", "month", t.dated("trips"))
    monthly = recent.groupBy("driver_id", period("dispatch_date", "month").alias("month")).agg(
        mean("average_mpg", 2, num_type=SMALL_AMOUNT).alias("avg_mpg")
    )
    return monthly.orderBy(sort_key("avg_mpg", True), F.col("driver_id").asc_nulls_last()).limit(1)
