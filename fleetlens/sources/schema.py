"""Declared schemas of the eight logical tables the reports read.

Money, miles, mpg and hours are exact decimals: every report rounds them with
decimal (half away from zero) semantics, which a double cannot reproduce.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

MONEY = DecimalType(12, 2)
MILES = DecimalType(12, 2)
MPG = DecimalType(6, 2)
HOURS = DecimalType(8, 2)


def _struct(*fields: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(name, dtype, nullable) for name, dtype, nullable in fields])


SCHEMAS: dict[str, StructType] = {
    "trips": _struct(
        ("trip_id", LongType(), False),
        ("load_id", LongType(), True),
        ("driver_id", LongType(), True),
        ("truck_id", LongType(), True),
        ("dispatch_date", DateType(), True),
        ("actual_distance_miles", MILES, True),
        ("average_mpg", MPG, True),
    ),
    "delivery_events": _struct(
        ("event_id", LongType(), True),
        ("trip_id", LongType(), True),
        ("actual_date", DateType(), True),
        ("on_time_flag", BooleanType(), True),
    ),
    "loads": _struct(
        ("load_id", LongType(), False),
        ("customer_id", LongType(), True),
        ("route_id", IntegerType(), True),
        ("load_date", DateType(), True),
        ("revenue", MONEY, True),
    ),
    "fuel_purchases": _struct(
        ("trip_id", LongType(), True),
        ("total_cost", MONEY, True),
    ),
    "maintenance_records": _struct(
        ("truck_id", LongType(), True),
        ("maintenance_date", DateType(), True),
        ("total_cost", MONEY, True),
        ("downtime_hours", HOURS, True),
    ),
    "trucks": _struct(("truck_id", LongType(), False)),
    "customers": _struct(
        ("customer_id", LongType(), False),
        ("customer_name", StringType(), True),
    ),
    "safety_incidents": _struct(
        ("driver_id", LongType(), True),
        ("incident_date", DateType(), True),
        ("preventable_flag", BooleanType(), True),
    ),
}

TABLE_NAMES = tuple(SCHEMAS)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project ``df`` onto the declared schema of logical table ``name``.

    Columns are selected by name and cast to the declared type, so extra
    columns are pruned before any scan and a type drift fails at analysis time
    instead of silently changing rounding. A missing column raises.
    """
    schema = SCHEMAS[name]
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    # A column that fits stays as it is: an alias would make two readings of one
    # table look different, and their shuffles would not be shared.
    fits = {f.name for f in schema.fields if df.schema[f.name].dataType == f.dataType}
    return df.select(*[F.col(f.name) if f.name in fits else F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
