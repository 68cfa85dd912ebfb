"""Cross-report invariants on the sf0.01 fixtures."""

from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001

from fleetlens.plans.registry import load_all
from fleetlens.sources import load_fixture_tables

R = load_all()


@pytest.fixture(scope="module")
def t(spark):
    return load_fixture_tables(spark, SF001)


def _sum(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_shares_add_up_to_a_hundred(t):
    for key, col in (("customer_revenue_share", "customer_revenue_percentage"),
                     ("season_revenue_share", "seasonal_revenue_contribution")):
        df = R[key].build(t)
        total = _sum(df, col)
        # each share is rounded to 2 decimals: the error is at most 0.005 per row
        assert abs(total - D(100)) <= D("0.005") * df.count(), (key, total)


def test_monthly_volumes_add_up_to_the_table(t):
    assert _sum(R["load_volume_monthly"].build(t), "load_volume") == t.loads.count()
    assert _sum(R["load_volume_quarterly"].build(t), "load_volume") == t.loads.count()
    assert _sum(R["trip_volume_monthly"].build(t), "trip_volume") == t.trips.count()


def test_peak_month_reports_agree(t):
    a = [tuple(r) for r in R["peak_load_month"].build(t).collect()]
    b = [tuple(r) for r in R["busiest_load_month"].build(t).collect()]
    assert a == b and len(a) >= 1


def test_driver_incidents_add_up(t):
    non_null = t.safety_incidents.where(F.col("driver_id").isNotNull()).count()
    assert _sum(R["driver_incidents"].build(t), "total_incidents") == non_null
    assert _sum(R["driver_preventable_rate"].build(t), "total_incidents") == non_null


def test_route_revenue_is_all_loads(t):
    loads_total = _sum(t.loads, "revenue")
    assert _sum(R["route_net_profit"].build(t), "total_revenue") == loads_total
    assert _sum(R["route_revenue"].build(t), "total_revenue") == loads_total
    assert _sum(R["customer_revenue"].build(t), "total_revenue") == loads_total


def test_fuel_reports_agree(t):
    a = {r.route_id: r.total_fuel_cost for r in R["route_fuel_cost"].build(t).collect()}
    b = {r.route_id: r.total_fuel_cost for r in R["route_net_profit"].build(t).collect()}
    assert a == {k: v for k, v in b.items() if k in a}


def test_rolling_mean_of_a_first_month_is_its_value(t):
    df = R["truck_rolling_miles"].build(t)
    first = df.withColumn(
        "n", F.row_number().over(Window.partitionBy("truck_id").orderBy("month"))
    ).where("n = 1")
    bad = first.where(F.col("rolling_3_month_avg_miles") != F.round("total_miles", 2)).count()
    assert bad == 0


def test_top_decile_is_a_tenth_of_the_drivers(t):
    drivers = R["driver_revenue_per_mile"].build(t).count()
    assert R["driver_top_decile"].build(t).count() == -(-drivers // 10)


def test_monthly_rank_starts_at_one_each_month(t):
    df = R["driver_monthly_on_time_rank"].build(t)
    mins = df.groupBy("month").agg(F.min("monthly_rank").alias("m"))
    assert mins.where("m <> 1").count() == 0
