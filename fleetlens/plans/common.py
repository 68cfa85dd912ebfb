"""Joins and pre-aggregations shared by several reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.sources import Tables


def trips_with_loads(t: Tables, *trip_cols: str, how: str = "inner", load_cols=("revenue",)) -> DataFrame:
    """Trips joined to their load on ``load_id``; a load's columns repeat once per trip.

    Only the named columns are selected on each side before the join, so the
    scans read just those columns and the shuffle carries nothing else. Trips
    come in the layout for loads where there is one; bucketed like the loads,
    the join then needs no shuffle.
    """
    trips = t.for_loads().select("load_id", *trip_cols)
    loads = t.loads.select("load_id", *load_cols)
    return trips.join(loads, "load_id", how)


def fuel_per_trip(t: Tables) -> DataFrame:
    """Fuel cost summed per trip before any join.

    A trip can have many fuel rows; summing them first (partial aggregation
    on the map side) shrinks the join input, and the result is already
    hash-partitioned on ``trip_id`` for the join that follows.
    """
    return t.fuel_purchases.groupBy("trip_id").agg(F.sum("total_cost").alias("trip_fuel_cost"))
