"""Hot keys and mass ties: every report against its oracle SQL.

Built by a fixed rule (no randomness): driver 1, truck 1, load 1 and route 7
carry a third or more of the rows, many measures tie, and some keys are null.
"""

import datetime as dt
from decimal import Decimal as D

import pytest

from micro import duck_tables, spark_tables
from oracle_check import _rows

from fleetlens.plans.registry import decimals_to_double, load_all
from oracle import oracle_bodies

REPORTS = load_all()
BODIES = oracle_bodies()


def _skewed_rows():
    base = dt.date(2023, 1, 1)
    loads, trips, events, fuel, maint, incidents = [], [], [], [], [], []
    for lid in range(1, 61):
        route = 7 if lid % 3 else (lid % 5)
        day = base + dt.timedelta(days=(lid * 11) % 700)
        loads.append((lid, lid % 4 + 1, route, day, D(100 + (lid % 3) * 50)))
    tid = 0
    for i in range(240):
        tid += 1
        load = 1 if i % 3 == 0 else (i % 60) + 1  # load 1 holds a third of the trips
        driver = 1 if i % 2 == 0 else (None if i % 7 == 0 else i % 9)  # driver 1: half
        truck = 1 if i % 3 else (None if i % 11 == 0 else i % 13)  # truck 1: two thirds
        day = base + dt.timedelta(days=(i * 17) % 720)
        miles = D(i % 4 * 10)  # many equal values, some zero
        mpg = None if i % 10 == 0 else D("6.00") + D(i % 3)
        trips.append((tid, load, driver, truck, day, miles, mpg))
        events.append((i, tid, day, None if i % 5 == 0 else i % 2 == 0))
        if i % 4:
            fuel.append((tid, D("10.00")))
            fuel.append((tid, D(i % 3)))
        maint.append((1 if i % 2 else (i % 6) + 2, day, D(5), D(i % 2)))
        incidents.append((1 if i % 3 else i % 8, day, None if i % 4 == 0 else i % 2 == 0))
    return {
        "customers": [(c, f"C{c}") for c in range(1, 6)],
        "loads": loads,
        "trips": trips,
        "delivery_events": events,
        "fuel_purchases": fuel,
        "maintenance_records": maint,
        "trucks": [(k,) for k in range(1, 15)],
        "safety_incidents": incidents,
    }


ROWS = _skewed_rows()


@pytest.fixture(scope="module")
def tables(spark):
    return spark_tables(spark, ROWS)


@pytest.fixture(scope="module")
def con():
    return duck_tables(ROWS)


@pytest.mark.parametrize("key", list(REPORTS))
def test_skewed_report_matches_oracle(spark, tables, con, key):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        sdf = decimals_to_double(REPORTS[key].build(tables))
        s_rows = _rows(sdf.columns, [tuple(r) for r in sdf.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    res = con.execute(BODIES[key])
    o_rows = _rows([c[0] for c in res.description], res.fetchall())
    assert s_rows == o_rows, key
