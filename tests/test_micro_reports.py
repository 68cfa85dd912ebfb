"""Every report against its oracle SQL on the hand-built micro tables."""

import pytest

from micro import duck_tables, spark_tables
from oracle_check import _rows

from fleetlens.plans.registry import decimals_to_double, load_all
from fleetlens.sources import SCHEMAS
from oracle import oracle_bodies

REPORTS = load_all()
BODIES = oracle_bodies()


@pytest.fixture(scope="module")
def tables(spark):
    return spark_tables(spark)


@pytest.fixture(scope="module")
def con():
    return duck_tables()


@pytest.mark.parametrize("key", list(REPORTS))
def test_micro_report_matches_oracle(tables, con, key):
    sdf = decimals_to_double(REPORTS[key].build(tables))
    s_rows = _rows(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(BODIES[key])
    o_cols = [c[0] for c in res.description]
    o_rows = _rows(o_cols, res.fetchall())
    assert sorted(sdf.columns) == sorted(o_cols)
    assert s_rows == o_rows, f"{key}\nspark={s_rows}\noracle={o_rows}"


@pytest.fixture(scope="module")
def empty(spark):
    rows = {name: [] for name in SCHEMAS}
    return spark_tables(spark, rows), duck_tables(rows)


@pytest.mark.parametrize("key", list(REPORTS))
def test_empty_tables_match_oracle(empty, key):
    tables, con = empty
    sdf = decimals_to_double(REPORTS[key].build(tables))
    s_rows = _rows(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(BODIES[key])
    o_rows = _rows([c[0] for c in res.description], res.fetchall())
    assert s_rows == o_rows, key
