"""Derive the logical tables from the TPC-H-like fixture tables.

The fixtures carry no trucking data, so each logical table is a projection of
``customer``, ``orders``, ``lineitem`` or ``part``. The same rules are written
as SQL in ``oracle/tables.py``; the two must stay in step.

Fixed values of the mapping (they decide which rows exist and which are null):
  trip_id        = l_orderkey * 10 + l_linenumber
  null driver    when l_linenumber = 6
  null truck     when l_linenumber = 7
  average_mpg    = 5 + 10 * max(l_discount) + 10 * max(l_tax)
  on_time_flag   false if l_returnflag = 'R'; null if 'N' with l_linestatus 'O'; else true
  fuel purchase  every lineitem with l_tax > 0
  maintenance    every lineitem with l_returnflag = 'R'; downtime = l_quantity - 1
  incident       every lineitem with l_returnflag = 'R' and l_linestatus = 'O';
                 preventable = l_discount >= 0.05, null when l_discount = 0
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from fleetlens.sources.schema import conform

FIXTURE_TABLES = ("customer", "orders", "lineitem", "part")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _trip_id() -> F.Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def derive_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazy DataFrames for the eight logical tables over one fixture folder."""
    customer = _read(spark, sf_dir, "customer")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    part = _read(spark, sf_dir, "part")

    customers = customer.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name")
    )

    # customer is a dimension; AQE broadcasts it when its measured size allows
    # and falls back to a shuffle join otherwise.
    loads = orders.join(
        customer.select("c_custkey", "c_nationkey"),
        orders.o_custkey == customer.c_custkey,
        "inner",
    ).select(
        F.col("o_orderkey").alias("load_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_nationkey").alias("route_id"),
        F.col("o_orderdate").cast("date").alias("load_date"),
        F.col("o_totalprice").cast(DecimalType(12, 2)).alias("revenue"),
    )

    # (l_orderkey, l_linenumber) is not unique in the fixtures: one trip per pair.
    trips = (
        lineitem.groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_suppkey").alias("min_supp"),
            F.min("l_partkey").alias("min_part"),
            F.min("l_shipdate").alias("first_ship"),
            F.sum(F.col("l_quantity").cast(DecimalType(8, 2))).alias("miles"),
            F.max(F.col("l_discount").cast(DecimalType(4, 2))).alias("max_disc"),
            F.max(F.col("l_tax").cast(DecimalType(4, 2))).alias("max_tax"),
        )
        .select(
            _trip_id().alias("trip_id"),
            F.col("l_orderkey").alias("load_id"),
            F.when(F.col("l_linenumber") != 6, F.col("min_supp")).alias("driver_id"),
            F.when(F.col("l_linenumber") != 7, F.col("min_part")).alias("truck_id"),
            F.col("first_ship").cast("date").alias("dispatch_date"),
            F.col("miles").cast(DecimalType(12, 2)).alias("actual_distance_miles"),
            (F.lit(5) + F.lit(10) * F.col("max_disc") + F.lit(10) * F.col("max_tax"))
            .cast(DecimalType(6, 2))
            .alias("average_mpg"),
        )
    )

    delivery_events = lineitem.select(
        F.col("l_partkey").alias("event_id"),
        _trip_id().alias("trip_id"),
        F.col("l_shipdate").cast("date").alias("actual_date"),
        F.when(F.col("l_returnflag") == "R", F.lit(False))
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.lit(None))
        .otherwise(F.lit(True))
        .alias("on_time_flag"),
    )

    fuel_purchases = lineitem.where(F.col("l_tax") > 0).select(
        _trip_id().alias("trip_id"),
        F.col("l_extendedprice").cast(DecimalType(12, 2)).alias("total_cost"),
    )

    maintenance_records = lineitem.where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("truck_id"),
        F.col("l_shipdate").cast("date").alias("maintenance_date"),
        F.col("l_extendedprice").cast(DecimalType(12, 2)).alias("total_cost"),
        (F.col("l_quantity") - 1).cast(DecimalType(8, 2)).alias("downtime_hours"),
    )

    safety_incidents = lineitem.where(
        (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    ).select(
        F.when(F.col("l_linenumber") != 6, F.col("l_suppkey")).alias("driver_id"),
        F.col("l_shipdate").cast("date").alias("incident_date"),
        F.when(F.col("l_discount") != 0, F.col("l_discount") >= 0.05).alias("preventable_flag"),
    )

    trucks = part.select(F.col("p_partkey").alias("truck_id"))

    raw = {
        "trips": trips,
        "delivery_events": delivery_events,
        "loads": loads,
        "fuel_purchases": fuel_purchases,
        "maintenance_records": maintenance_records,
        "trucks": trucks,
        "customers": customers,
        "safety_incidents": safety_incidents,
    }
    return {name: conform(df, name) for name, df in raw.items()}
