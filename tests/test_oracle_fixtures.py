"""Every report against its DuckDB oracle on the sf0.01 fixtures (the driver's gate)."""

import pytest

from conftest import SF001
from oracle_check import compare, duck

import __spark_entry__ as entry
from fleetlens.plans.registry import load_all

KEYS = list(load_all())


def test_every_report_has_an_oracle():
    assert len(KEYS) == 59
    assert set(KEYS) <= set(entry.oracle_sql())
    assert set(KEYS) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", KEYS)
def test_report_matches_oracle(spark, con, key):
    ok, msg = compare(spark, con, key, SF001)
    assert ok, f"{key}: {msg}"


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["route_id", "quarter", "net_profit", "rank_in_quarter"]
    assert len(rows) > 0
