"""Hand-computed expectations for the edge rules, on the micro tables."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from micro import spark_tables

from fleetlens.functions import quarter_label_of, ratio, season
from fleetlens.functions.exact import COUNT
from fleetlens.plans.registry import load_all

R = load_all()


@pytest.fixture(scope="module")
def t(spark):
    return spark_tables(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_ratio_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(201, 200), (-201, 200), (1, 0), (None, 3), (2, 3)], "n long, d long")
    out = df.select(ratio(F.col("n"), F.col("d"), 2, num_type=COUNT, den_type=COUNT).alias("r"))
    assert [r.r for r in out.collect()] == [D("1.01"), D("-1.01"), None, None, D("0.67")]


def test_quarter_label_and_season_of_null_date(spark):
    df = spark.createDataFrame([(None,)], "d date")
    row = df.select(quarter_label_of(F.year("d"), F.quarter("d")).alias("q"), season("d").alias("s")).first()
    assert (row.q, row.s) == ("Q-", "Unknown")


def test_season_edges(spark):
    dates = ["2024-12-01", "2024-02-29", "2024-03-01", "2024-04-30", "2024-05-01",
             "2024-06-30", "2024-07-01", "2024-09-30", "2024-10-01", "2024-11-30"]
    df = spark.createDataFrame([(d,) for d in dates], "s string").select(F.to_date("s").alias("d"))
    got = [r.x for r in df.select(season("d").alias("x")).collect()]
    assert got == ["Winter", "Winter", "Spring", "Spring", "Summer/Pre-monsoon",
                   "Summer/Pre-monsoon", "Monsoon/Rainy", "Monsoon/Rainy",
                   "Autumn/Post-monsoon", "Autumn/Post-monsoon"]


def test_null_event_id_and_null_flag(t):
    got = {r.driver_id: r for r in R["driver_on_time"].build(t).collect()}
    # driver 101: a null-flag event counts in the total; a null event id does not, but its
    # true flag still counts as on time (the on-time count counts rows, the total counts ids)
    assert (got[101].total_deliveries, got[101].on_time_deliveries) == (2, 1)
    assert got[101].on_time_delivery_rate == D("50.00")
    assert got[None].total_deliveries == 1  # the null driver is its own group


def test_zero_miles_driver_leads_the_top_decile(t):
    # 5 drivers -> first tile holds ceil(5/10) = 1 row; a null ratio sorts first (DESC NULLS FIRST)
    assert rows(R["driver_top_decile"].build(t)) == [(102, D("0.00"), D("301.00"), None, 1)]


def test_latest_month_best_mpg_prefers_null(t):
    # June 2024: driver 102 has only null mpg, driver 101 has 9.99; nulls sort first on DESC
    out = rows(R["driver_best_mpg_latest_month"].build(t))
    assert len(out) == 1 and out[0][0] == 102 and out[0][2] is None


def test_six_month_window_is_inclusive_and_month_end_clamped(t):
    got = {r.truck_id: (r.total_downtime, r.downtime_rank) for r in R["truck_top5_downtime_6m"].build(t).collect()}
    # max 2024-08-31 minus 6 months = 2024-02-29: that day counts, 2024-02-28 does not
    assert got[1] == (D("4.00"), 2)
    assert got[4] == got[5] == got[6] == (D("5.00"), 1)
    assert got[None] == (D("1.50"), 3)
    assert got[2] == got[3] == (D("0.00"), 4)


def test_zero_downtime_includes_recorded_zeros(t):
    got = [r.truck_id for r in R["truck_zero_downtime_quarter"].build(t).collect()]
    # Q3 2024: truck 2 recorded 0, truck 3 sums to 0, trucks 1, 4, 7 have no record
    assert got == [1, 2, 3, 4, 7]


def test_no_non_preventable_incidents_gives_null_ratio(t):
    assert rows(R["preventable_ratio"].build(t)) == [(4, 0, None)]


def test_empty_incident_table_gives_null_sums(spark, t):
    empty = t.safety_incidents.limit(0)
    t2 = type(t)(**{**t.as_dict(), "safety_incidents": empty})
    assert rows(R["preventable_ratio"].build(t2)) == [(None, None, None)]


def test_null_load_date_labels(t):
    quarters = dict(rows(R["load_volume_quarterly"].build(t)))
    assert quarters["Q-"] == 1
    seasons = {r.season: r.seasonal_revenue for r in R["season_revenue_share"].build(t).collect()}
    assert seasons["Unknown"] == D("300.00")
    assert seasons["Winter"] == D("1750.51")  # Jan 1000.00 + Feb 500.00 + 0.01 + Dec 250.50


def test_lag_steps_over_missing_months(t):
    out = rows(R["incident_mom"].build(t))
    # months Jan, Feb, Mar, May; the first is dropped, May follows March
    assert out == [("Feb-2024", 1, 2, 1), ("Mar-2024", 2, 2, 0), ("May-2024", 2, 1, -1)]


def test_route_month_with_revenue_but_no_fuel(t):
    got = {(r.route_id, str(r.month)): r.net_profit for r in R["route_profit_mom"].build(t).collect()}
    assert got[(20, "2024-03-01")] == D("201.00")


def test_missing_load_still_counts_for_the_truck(t):
    got = dict(rows(R["truck_revenue"].build(t)))
    # truck 2: trip 12 (load 1: 1000.00) and trip 61 (load 99 missing -> null)
    assert got[2] == D("1000.00")


def test_register_views_exposes_logical_tables(spark, t):
    t.register_views()
    assert spark.sql("SELECT COUNT(*) FROM trips").first()[0] == t.trips.count()
    assert spark.sql("SELECT SUM(revenue) FROM loads").first()[0] == t.loads.agg(F.sum("revenue")).first()[0]
