"""Safety incidents per driver and over time (Q46-Q51)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import COUNT, month_label, period, ratio
from fleetlens.operators import dense_rank_of_few, period_delta, present, sort_key
from fleetlens.plans.registry import report
from fleetlens.sources import Tables


def _flag_count(value: bool) -> F.Column:
    """Rows whose preventable flag equals ``value``; a null flag counts in neither."""
    return F.sum(F.when(F.col("preventable_flag") == F.lit(value), F.lit(1)).otherwise(F.lit(0)))


def _driver_incidents(t: Tables) -> DataFrame:
    return (
        t.safety_incidents.where(F.col("driver_id").isNotNull())
        .groupBy("driver_id")
        .agg(F.count(F.lit(1)).alias("total_incidents"))
    )


@report("driver_incidents", 46, "Incident count per driver")
def driver_incidents(t: Tables) -> DataFrame:
    return _driver_incidents(t).orderBy(F.col("total_incidents").desc(), F.col("driver_id").asc_nulls_last())


@report("driver_preventable_rate", 47, "Preventable incident rate per driver")
def driver_preventable_rate(t: Tables) -> DataFrame:
    agg = (
        t.safety_incidents.where(F.col("driver_id").isNotNull())
        .groupBy("driver_id")
        .agg(_flag_count(True).alias("preventable_incidents"), F.count(F.lit(1)).alias("total_incidents"))
    )
    rate = ratio(
        F.col("preventable_incidents"), F.col("total_incidents"), 2,
        pct=True, num_type=COUNT, den_type=COUNT,
    )
    return agg.withColumn("preventable_rate_pct", rate).orderBy(sort_key("preventable_rate_pct", True), F.col("driver_id").asc_nulls_last())


@report("incident_mom", 48, "Monthly incident count and change")
def incident_mom(t: Tables) -> DataFrame:
    monthly = t.safety_incidents.groupBy(period("incident_date", "month").alias("m")).agg(
        F.count(F.lit(1)).alias("current_month_incidents")
    )
    # One row per month: the unpartitioned window runs over a bounded series.
    out = period_delta(
        monthly, [], "m", "current_month_incidents", "prev_month_incidents",
        "monthly_incident_change", keep_first=False,
    )
    return present(out, F.col("m").asc_nulls_last(), bounded=True).select(
        month_label("m").alias("incident_month"),
        "prev_month_incidents",
        "current_month_incidents",
        "monthly_incident_change",
    )


@report("driver_incident_rank", 49, "Drivers ranked by incident count")
def driver_incident_rank(t: Tables) -> DataFrame:
    # Every driver is in one rank group; counts that add up to all incidents are few.
    ranked = dense_rank_of_few(_driver_incidents(t), "total_incidents", "incident_frequency_rank")
    return ranked.orderBy(F.col("total_incidents").desc(), F.col("driver_id").asc_nulls_last())


@report("preventable_ratio", 50, "Preventable to non-preventable incident ratio")
def preventable_ratio(t: Tables) -> DataFrame:
    counts = t.safety_incidents.agg(
        _flag_count(True).alias("preventable_incidents"),
        _flag_count(False).alias("non_preventable_incidents"),
    )
    return counts.withColumn(
        "preventable_to_non_preventable_ratio",
        ratio(
            F.col("preventable_incidents"), F.col("non_preventable_incidents"), 2,
            num_type=COUNT, den_type=COUNT,
        ),
    )


@report("driver_incidents_per_100_trips", 51, "Incidents per 100 trips per driver")
def driver_incidents_per_100_trips(t: Tables) -> DataFrame:
    trips = (
        t.trips.where(F.col("driver_id").isNotNull())
        .groupBy("driver_id")
        .agg(F.count(F.lit(1)).alias("total_trips"))
    )
    joined = trips.join(_driver_incidents(t), "driver_id", "left")
    incidents = F.coalesce(F.col("total_incidents"), F.lit(0))
    return joined.select(
        "driver_id",
        incidents.alias("total_incidents"),
        "total_trips",
        ratio(incidents, F.col("total_trips"), 2, pct=True, num_type=COUNT, den_type=COUNT).alias(
            "incidents_per_100_trips"
        ),
    ).orderBy(sort_key("incidents_per_100_trips", True), F.col("driver_id").asc_nulls_last())
