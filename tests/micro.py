"""Hand-built logical tables aimed at the edge rules of the reports.

Each row is there for a reason (see the comment beside it). The same rows
are loaded into Spark (with the declared schemas) and into DuckDB (with the
matching SQL types), so a report can be checked against its oracle SQL on
cases the fixture data does not reach.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import duckdb
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
)

from fleetlens.sources import SCHEMAS, Tables


def d(s: str | None):
    return None if s is None else dt.date.fromisoformat(s)


ROWS = {
    "customers": [(1, "Acme"), (2, "Beta"), (3, "Cargo")],
    # load_id, customer_id, route_id, load_date, revenue
    "loads": [
        (1, 1, 10, d("2024-01-15"), D("1000.00")),
        (2, 1, 10, d("2024-02-10"), D("500.00")),
        (3, 2, 20, d("2024-03-01"), D("201.00")),
        (4, 2, 20, d("2024-04-30"), D("0.00")),
        (5, 3, 30, None, D("300.00")),  # null load date: 'Q-' label, 'Unknown' season
        (6, 3, 30, d("2024-12-31"), D("250.50")),  # load with no trip; December is winter
        (7, 1, None, d("2024-06-30"), D("100.00")),  # null route
        (8, 2, 10, d("2024-05-01"), D("0.00")),
        (9, 2, 20, d("2024-02-29"), D("0.01")),
    ],
    # trip_id, load_id, driver_id, truck_id, dispatch_date, miles, mpg
    "trips": [
        (11, 1, 100, 1, d("2024-01-20"), D("200.00"), D("6.50")),
        (12, 1, 101, 2, d("2024-01-25"), D("300.00"), D("7.25")),
        (21, 2, 100, 1, d("2024-04-05"), D("150.00"), D("6.75")),  # truck 1: Jan, Apr (gap)
        (31, 3, 102, 3, d("2024-03-02"), D("0.00"), None),  # zero miles; only trip of route 20 in March, no fuel
        (41, 4, None, 1, d("2024-05-10"), D("120.00"), D("8.00")),  # null driver
        (51, 5, 101, None, d("2024-05-20"), D("80.00"), D("5.55")),  # null truck
        (61, 99, 100, 2, d("2024-05-31"), D("90.00"), D("6.05")),  # load 99 does not exist
        (71, 7, 102, 4, d("2024-06-15"), D("0.00"), None),  # latest month: driver 102 has only null mpg
        (81, 8, 101, 5, d("2024-06-30"), D("40.00"), D("9.99")),
        (91, 9, 103, 6, d("2024-02-29"), D("0.01"), D("6.00")),
    ],
    # event_id, trip_id, actual_date, on_time_flag
    "delivery_events": [
        (1, 11, d("2024-01-21"), True),
        (2, 11, d("2024-01-22"), False),
        (3, 12, d("2024-01-26"), None),  # null flag: counted, not on time
        (4, 21, d("2024-04-06"), True),
        (5, 31, d("2024-03-03"), True),
        (6, 41, d("2024-05-11"), None),
        (7, 61, d("2024-06-01"), True),
        (8, 81, d("2024-07-01"), False),
        (9, 71, d("2024-06-16"), True),
        (None, 51, d("2024-05-21"), True),  # null event id: not counted by count(event_id)
    ],
    # trip_id, total_cost
    "fuel_purchases": [
        (11, D("50.00")),
        (11, D("25.50")),  # several fuel rows for one trip
        (12, D("60.00")),
        (21, D("40.00")),
        (41, D("30.00")),
        (61, D("20.00")),
        (81, D("10.00")),
        (999, D("5.00")),  # fuel for a trip that does not exist
    ],
    # truck_id, maintenance_date, total_cost, downtime_hours
    "maintenance_records": [
        (1, d("2024-01-05"), D("10.00"), D("1.00")),
        (1, d("2024-02-29"), D("100.00"), D("2.00")),  # exactly 6 months before the max: kept
        (1, d("2024-02-28"), D("50.00"), D("1.00")),  # one day earlier: dropped
        (1, d("2024-05-02"), D("12.00"), D("2.00")),
        (2, d("2024-08-31"), D("200.00"), D("0.00")),  # the max, on the 31st; zero downtime recorded
        (3, d("2024-07-15"), D("80.00"), D("3.00")),
        (3, d("2024-08-01"), D("20.00"), D("-3.00")),  # sums to zero in the latest quarter
        (4, d("2024-05-05"), D("10.00"), D("5.00")),
        (None, d("2024-06-01"), D("15.00"), D("1.50")),  # null truck
        (5, d("2024-08-10"), D("30.00"), D("5.00")),
        (6, d("2024-08-11"), D("30.00"), D("5.00")),  # tie with truck 5
    ],
    "trucks": [(1,), (2,), (3,), (4,), (5,), (6,), (7,)],  # truck 7: no records at all
    # driver_id, incident_date, preventable_flag
    "safety_incidents": [
        (100, d("2024-01-10"), True),
        (100, d("2024-02-10"), None),  # null flag: in the total, in neither bucket
        (101, d("2024-02-15"), True),
        (None, d("2024-03-01"), True),  # null driver: in company totals only
        (102, d("2024-03-05"), True),
        (101, d("2024-05-05"), None),  # April missing: lag steps over the gap
    ],
}


def _sql_type(dtype) -> str:
    if isinstance(dtype, LongType):
        return "BIGINT"
    if isinstance(dtype, IntegerType):
        return "INTEGER"
    if isinstance(dtype, DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    if isinstance(dtype, DateType):
        return "DATE"
    if isinstance(dtype, BooleanType):
        return "BOOLEAN"
    if isinstance(dtype, StringType):
        return "VARCHAR"
    raise TypeError(dtype)


def spark_tables(spark, rows=None) -> Tables:
    rows = rows or ROWS
    return Tables.from_dict(
        {name: spark.createDataFrame(rows[name], SCHEMAS[name]) for name in SCHEMAS}
    )


def duck_tables(rows=None) -> duckdb.DuckDBPyConnection:
    rows = rows or ROWS
    con = duckdb.connect()
    for name, schema in SCHEMAS.items():
        cols = ", ".join(f"{f.name} {_sql_type(f.dataType)}" for f in schema.fields)
        con.execute(f"CREATE TABLE {name} ({cols})")
        if rows[name]:
            marks = ", ".join("?" for _ in schema.fields)
            con.executemany(f"INSERT INTO {name} VALUES ({marks})", [list(r) for r in rows[name]])
    return con
