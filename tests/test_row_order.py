"""Row order of every ordered report against the oracle's rows, sorted as the statement says.

The micro tables have undated rows and ties. A clause is the statement's ORDER
BY with its null order, and the entity last.
"""

import pytest

from micro import duck_tables, spark_tables
from oracle_check import _norm
from test_skew import ROWS as SKEWED

from fleetlens.plans.registry import decimals_to_double, load_all
from oracle import oracle_bodies

BODIES = oracle_bodies()


def down(col, *then):
    return ", ".join([f"{col} DESC NULLS FIRST", *(f"{c} ASC NULLS LAST" for c in then)])


def up(*cols):
    return ", ".join(f"{c} ASC NULLS LAST" for c in cols)


def label(col):
    return f"strptime({col}, '%b-%Y') ASC NULLS LAST"


ORDER = {
    "driver_on_time": down("on_time_delivery_rate", "driver_id"),
    "driver_mpg": down("avg_driver_mpg", "driver_id"),
    "driver_revenue_per_mile": down("revenue_per_mile", "driver_id"),
    "driver_monthly_on_time_rank": up("month", "monthly_rank", "driver_id"),
    "driver_top_decile": down("revenue_per_mile", "driver_id"),
    "driver_mpg_vs_fleet": down("mpg_difference", "driver_id"),
    "driver_revenue_mom": up("driver_id", "month"),
    "route_revenue": down("total_revenue", "route_id"),
    "route_fuel_cost": down("total_fuel_cost", "route_id"),
    "route_net_profit": down("net_profit", "route_id"),
    "route_profit_mom": up("route_id", "month"),
    "route_top5_quarter": up("quarter", "rank_in_quarter", "route_id"),
    "route_rising_fuel": up("route_id", "month"),
    "route_profit_vs_company": up("route_id"),
    "truck_miles": down("total_miles", "truck_id"),
    "truck_revenue": down("total_revenue", "truck_id"),
    "truck_revenue_monthly": up("truck_id", "month"),
    "truck_rolling_miles": up("truck_id", "month"),
    "truck_revenue_rank_monthly": up("month", "monthly_revenue_rank", "truck_id"),
    "truck_miles_vs_fleet": up("truck_id"),
    "truck_miles_growth": up("truck_id", "month"),
    "truck_maintenance_cost": down("total_maintenance_cost", "truck_id"),
    "truck_downtime": down("total_downtime_hours", "truck_id"),
    "truck_maintenance_per_mile": down("cost_per_mile", "truck_id"),
    "truck_maintenance_mom": up("truck_id", "month"),
    "truck_top5_downtime_6m": down("total_downtime", "truck_id"),
    "truck_downtime_vs_trips": up("truck_id", "operational_month"),
    "truck_maintenance_vs_revenue": down("net_operational_profit", "truck_id"),
    "truck_zero_downtime_quarter": up("truck_id"),
    "route_mpg": down("avg_mpg", "route_id"),
    "route_fuel_per_mile": down("cost_per_mile", "route_id"),
    "route_mpg_mom": up("route_id", "month"),
    "route_mpg_rank": down("avg_mpg", "route_id"),
    "route_rolling_mpg": up("route_id", "month"),
    "customer_revenue": down("total_revenue", "customer_id"),
    "customer_revenue_per_load": down("revenue_per_load", "customer_id"),
    "customer_revenue_mom": up("customer_id", "month"),
    "customer_top5_quarter": "quarter ASC NULLS LAST, " + down("quarterly_revenue", "customer_id"),
    "customer_revenue_share": down("customer_revenue_percentage", "customer_id"),
    "customer_revenue_growth": up("customer_id", "month"),
    "customer_top_year": up("customer_id", "customer_name"),
    "driver_incidents": down("total_incidents", "driver_id"),
    "driver_preventable_rate": down("preventable_rate_pct", "driver_id"),
    "incident_mom": label("incident_month"),
    "driver_incident_rank": down("total_incidents", "driver_id"),
    "driver_incidents_per_100_trips": down("incidents_per_100_trips", "driver_id"),
    "load_volume_monthly": label("month"),
    "revenue_mom": label("month"),
    "trip_volume_monthly": label("month"),
    "load_volume_quarterly": "nullif(split_part(quarter, '-', 2), '') ASC NULLS LAST, quarter",
    "load_volume_mom": label("month"),
    "season_revenue_share": down("seasonal_revenue_contribution", "season"),
}
REPORTS = load_all()


@pytest.fixture(scope="module", params=["micro", "skewed"])
def both(request, spark):
    rows = () if request.param == "micro" else (SKEWED,)
    return spark_tables(spark, *rows), duck_tables(*rows)


@pytest.mark.parametrize("key", list(ORDER))
def test_rows_come_in_the_statements_order(both, key):
    tables, con = both
    df = decimals_to_double(REPORTS[key].build(tables))
    res = con.execute(f"SELECT * FROM ({BODIES[key]}) ORDER BY {ORDER[key]}")
    names = [c[0] for c in res.description]
    want = [tuple(map(_norm, r)) for r in res.fetchall()]
    got = [tuple(_norm(r[n]) for n in names) for r in df.collect()]
    assert got == want


def test_below_median_is_sorted_by_the_unrounded_mean(spark):
    """Two means that round alike keep the order of the exact ones."""
    from decimal import Decimal as D

    rows = {name: [] for name in SKEWED}
    rows["loads"] = [(k, 1, k, None, D(1)) for k in range(1, 5)]
    mpg = {1: [D("5.00")] * 3 + [D("5.01")] * 30_001, 2: [D("5.00")] * 2 + [D("5.01")] * 30_002, 3: [D("9.00")], 4: [D("9.00")]}
    rows["trips"] = [(k * 100_000 + i, k, 1, 1, None, D(1), v) for k, values in mpg.items() for i, v in enumerate(values)]
    got = REPORTS["route_mpg_below_median"].build(spark_tables(spark, rows)).collect()
    assert [r.route_id for r in got] == [2, 1] and got[0].avg_mpg == got[1].avg_mpg
