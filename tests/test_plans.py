"""Plan checks: no Python in the plans, top-k pruning, pushdown, and answers
that do not depend on partitioning or broadcast choices."""

import os
import tempfile

import pytest

from conftest import SF001
from micro import spark_tables

from fleetlens.plans.registry import decimals_to_double, load_all
from fleetlens.sources import load_fixture_tables, read_tables, write_tables

R = load_all()


def plan_text(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def fixture_tables(spark):
    return load_fixture_tables(spark, SF001)


@pytest.fixture(scope="module")
def stored_tables(spark):
    path = tempfile.mkdtemp(prefix="fleetlens-stored-")
    # Several files per table, dated facts range-clustered by date.
    write_tables(spark_tables(spark), os.path.join(path, "t"), files=3)
    return read_tables(spark, os.path.join(path, "t"))


@pytest.mark.parametrize("key", R)
def test_no_python_in_plan(fixture_tables, key):
    text = plan_text(R[key].build(fixture_tables))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in text, f"{key} runs Python: {node}"


@pytest.mark.parametrize(
    "key",
    ["route_top5_quarter", "truck_top5_downtime_6m", "customer_top5_quarter",
     "customer_top_year", "peak_load_month", "busiest_load_month"],
)
def test_top_k_is_cut_before_the_shuffle(fixture_tables, key):
    assert "WindowGroupLimit" in plan_text(R[key].build(fixture_tables))


def test_scan_reads_only_needed_columns(fixture_tables):
    text = plan_text(R["route_revenue"].build(fixture_tables))
    orders_scan = [ln for ln in text.splitlines() if "ReadSchema" in ln and "o_" in ln]
    assert orders_scan and all("o_orderdate" not in ln and "o_orderkey" not in ln for ln in orders_scan)


@pytest.mark.parametrize(
    "key,column",
    [("truck_zero_downtime_quarter", "maintenance_date"),
     ("route_top_revenue_latest_month", "dispatch_date"),
     ("customer_top_year", "load_date"),
     ("truck_top5_downtime_6m", "maintenance_date")],
)
def test_latest_period_filter_reaches_the_scan(stored_tables, key, column):
    text = plan_text(R[key].build(stored_tables))
    pushed = [ln for ln in text.splitlines() if "PushedFilters" in ln and column in ln]
    assert any("ScalarSubquery" in ln for ln in pushed), text


def test_building_a_report_starts_no_job(spark, stored_tables):
    sc = spark.sparkContext
    sc.setJobGroup("build-only", "plans are built, not run")
    try:
        for key in R:
            R[key].build(stored_tables)
        assert list(sc.statusTracker().getJobIdsForGroup("build-only")) == []
    finally:
        sc.setJobGroup("", "")


@pytest.fixture(scope="module")
def usual_answers(stored_tables):
    return {key: _answer(key, stored_tables) for key in R}


def _answer(key, tables):
    df = decimals_to_double(R[key].build(tables))
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("key", R)
def test_same_answer_for_any_partitioning(spark, stored_tables, usual_answers, key):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert _answer(key, stored_tables) == usual_answers[key]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# Results bounded by the calendar; all others may hold any number of routes or entities.
_CALENDAR = {k for k, r in R.items() if r.number in (48, *range(52, 60))}


@pytest.mark.parametrize("key", [k for k in R if k not in _CALENDAR])
def test_no_result_is_sorted_in_one_task(fixture_tables, key):
    assert "REPARTITION_BY_NUM" not in plan_text(R[key].build(fixture_tables))


@pytest.mark.parametrize(
    "key,entity",
    [("driver_revenue_mom", "driver_id"), ("truck_rolling_miles", "truck_id"), ("truck_miles_growth", "truck_id"),
     ("truck_maintenance_mom", "truck_id"), ("truck_downtime_vs_trips", "truck_id"),
     ("customer_revenue_mom", "customer_id"), ("customer_revenue_growth", "customer_id")],
)
def test_one_range_exchange_serves_lag_and_sort(fixture_tables, key, entity):
    plan = R[key].build(fixture_tables)._jdf.queryExecution().executedPlan().toString()
    ranges = [ln for ln in plan.splitlines() if "Exchange rangepartitioning(" in ln]
    assert len(ranges) == 1 and entity in ranges[0], plan


@pytest.mark.parametrize("key", ["customer_revenue_mom", "customer_top5_quarter", "customer_revenue_growth", "customer_top_year"])
def test_loads_are_summed_before_they_meet_customers(spark, stored_tables, key):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R[key].build(stored_tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    below = plan[plan.index("SortMergeJoin"):]
    assert "partial_sum(revenue" in below, plan


@pytest.fixture(scope="module")
def date_partitioned_tables(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fleetlens-bydate-"), "t")
    write_tables(spark_tables(spark), path, partition_by_date=True)
    return read_tables(spark, path)


@pytest.mark.parametrize(
    "key,column",
    [("truck_zero_downtime_quarter", "maintenance_date"),
     ("truck_top5_downtime_6m", "maintenance_date"),
     ("customer_top_year", "load_date"),
     ("driver_best_mpg_latest_month", "dispatch_date")],
)
def test_date_partitioned_storage_prunes_folders(spark, date_partitioned_tables, stored_tables, key, column):
    df = R[key].build(date_partitioned_tables)
    text = plan_text(df)
    part = [ln for ln in text.splitlines() if "PartitionFilters" in ln and column in ln]
    assert any("subquery" in ln.lower() for ln in part), text
    same = decimals_to_double(R[key].build(stored_tables))
    assert sorted(map(tuple, decimals_to_double(df).collect()), key=repr) == sorted(
        map(tuple, same.collect()), key=repr
    )


def test_bucketed_trip_tables_join_without_shuffle(spark):
    from fleetlens.sources import read_catalog_tables, save_bucketed_tables

    location = tempfile.mkdtemp(prefix="fleetlens-bucketed-")
    save_bucketed_tables(spark_tables(spark), "fleet_bucketed", 4, location)
    bucketed = read_catalog_tables(spark, "fleet_bucketed")
    plain = spark_tables(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("route_fuel_cost", "driver_on_time"):
            df = R[key].build(bucketed)
            text = df._jdf.queryExecution().executedPlan().toString()
            # fuel/events summed per trip and joined to trips: no shuffle on trip_id
            assert "hashpartitioning(trip_id" not in text, text
            assert sorted(map(tuple, decimals_to_double(df).collect()), key=repr) == sorted(
                map(tuple, decimals_to_double(R[key].build(plain)).collect()), key=repr
            )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bucketed_load_tables_join_without_shuffle(spark):
    from fleetlens.sources import read_catalog_tables, save_bucketed_tables

    location = tempfile.mkdtemp(prefix="fleetlens-byload-")
    save_bucketed_tables(spark_tables(spark), "fleet_by_load", 4, location)
    bucketed = read_catalog_tables(spark, "fleet_by_load")
    plain = spark_tables(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("driver_revenue_per_mile", "driver_revenue_mom", "truck_revenue", "truck_revenue_monthly",
                    "truck_maintenance_vs_revenue", "route_mpg", "route_mpg_mom", "route_rolling_mpg"):
            df = R[key].build(bucketed)
            text = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in text and "hashpartitioning(load_id" not in text, text
            assert sorted(map(tuple, decimals_to_double(df).collect()), key=repr) == sorted(
                map(tuple, decimals_to_double(R[key].build(plain)).collect()), key=repr
            )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


HORIZON_REPORTS = ["driver_best_mpg_latest_month", "route_top_revenue_latest_month", "maintenance_horizon",
                   "truck_top5_downtime_6m", "truck_zero_downtime_quarter", "customer_top_year"]


@pytest.mark.parametrize("key", HORIZON_REPORTS)
def test_horizon_comes_from_file_statistics(spark, key):
    # Some dates are null, and the empty tables have no latest date.
    path = tempfile.mkdtemp(prefix="fleetlens-statistics-")
    full = spark_tables(spark)
    write_tables(full, os.path.join(path, "full"))
    write_tables(type(full)(**{n: df.limit(0) for n, df in full.as_dict().items()}), os.path.join(path, "empty"))
    for name in ("full", "empty"):
        told = read_tables(spark, os.path.join(path, name), dates_from_statistics=True)
        plain = read_tables(spark, os.path.join(path, name))
        df = R[key].build(told)
        text = plan_text(df)
        assert "PushedAggregation: [MAX(" in text, text
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, R[key].build(plain).collect()), key=repr)


def _records_by_exchange(node, out):
    """{partitioning: records written} of the shuffles of an executed plan."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _records_by_exchange(node.executedPlan(), out)
    if name.endswith("QueryStageExec"):
        return _records_by_exchange(node.plan(), out)
    if name == "ShuffleExchangeExec":
        key = (str(node.outputPartitioning().toString()).split("#")[0], node.child().toString().count("route_id") > 0)
        out[key] = out.get(key, 0) + node.metrics().apply("shuffleRecordsWritten").value()
    children = node.children().iterator()
    while children.hasNext():
        _records_by_exchange(children.next(), out)
    return out


def test_latest_month_filters_the_loads_before_their_shuffle(spark, fixture_tables):
    path = os.path.join(tempfile.mkdtemp(prefix="fleetlens-bloom-"), "t")
    write_tables(fixture_tables, path)
    tables = read_tables(spark, path)
    key, scan = "route_top_revenue_latest_month", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    n_loads = tables.loads.count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    usual = sorted(map(tuple, R[key].build(tables).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(scan, "0")  # as a fact table at scale, which is above the default
    try:
        df = R[key].build(tables)
        assert sorted(map(tuple, df.collect())) == usual
        plan = df._jdf.queryExecution().executedPlan()
        assert "might_contain" in plan.toString()
        written = _records_by_exchange(plan, {})
        loads = [n for (part, has_route), n in written.items() if part.startswith("hashpartitioning(load_id") and has_route]
        assert loads and 0 < sum(loads) < n_loads / 4, (written, n_loads)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset(scan)


def test_rising_routes_read_one_shuffle_of_the_monthly_fuel(spark, stored_tables):
    df = R["route_rising_fuel"].build(stored_tables)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0], plan


@pytest.mark.parametrize("key", ["truck_revenue_rank_monthly", "route_mpg_rank"])
def test_ranked_rows_are_dealt_out_once(spark, stored_tables, key):
    df = R[key].build(stored_tables)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [ln for ln in plan.splitlines() if " Exchange hashpartitioning(_cell" in ln and "ReusedExchange" not in ln]
    assert len(dealt) == 1, plan
