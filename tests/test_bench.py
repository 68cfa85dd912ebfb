"""bench.py prints one well-formed JSON line (run on the smallest fixtures)."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF0001


def test_bench_prints_one_json_line():
    env = dict(
        os.environ,
        BENCH_SF_DIR=SF0001,
        BENCH_RUNS="1",
        BENCH_CPUS="2",
        BENCH_REPORTS="route_revenue,driver_monthly_on_time_rank",
    )
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        env=env, capture_output=True, text=True, timeout=600, check=True,
    ).stdout.strip().splitlines()
    assert len(out) == 1
    result = json.loads(out[0])
    assert result["unit"] == "sec" and result["sf"] == 0.001
    assert set(result["queries"]) == {"route_revenue", "driver_monthly_on_time_rank"}
    assert result["value"] == round(sum(result["queries"].values()), 4)
    assert set(result["shuffle_bytes"]) == set(result["queries"])
