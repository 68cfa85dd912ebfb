"""Benchmark the reports at one fixture scale; prints one JSON line.

Protocol: the eight logical tables are derived from the fixture folder once
and stored as parquet (as they would be stored in production); that setup
is timed on its own. Every report is then run against the stored tables and
fully materialised with the ``noop`` writer: one warm-up pass over all
reports, then ``BENCH_RUNS`` timed passes; each report's time is its median.

Spark's event log is written to the scratch folder; after the runs it is
read back to add, per report and per execution, the shuffle bytes written
and the largest peak execution memory of any task.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8),
BENCH_RUNS (3), BENCH_REPORTS (comma-separated keys, default all),
BENCH_SHUFFLE_PARTITIONS (default 2 x BENCH_CPUS; AQE coalesces below it).
"""

from __future__ import annotations

import glob
import io
import json
import os
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from fleetlens.plans.registry import load_all  # noqa: E402
from fleetlens.session import build_session  # noqa: E402
from fleetlens.sources import load_fixture_tables, read_tables, write_tables  # noqa: E402


def _sf_of(path: str) -> float | str:
    name = os.path.basename(path.rstrip("/"))
    try:
        return float(name.removeprefix("sf"))
    except ValueError:
        return name


def _event_lines(log_dir: str):
    """Lines of every event-log file under ``log_dir`` (plain or zstd-compressed)."""
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "events*"), recursive=True)):
        if path.endswith(".zstd"):
            import zstandard  # baked into the image; only needed for compressed logs

            with open(path, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(path, encoding="utf-8") as fh:
                yield from fh


def _event_log_metrics(log_dir: str, executions: int) -> dict[str, dict[str, float]]:
    """Shuffle bytes written (per execution) and peak task memory per job group."""
    stage_group: dict[int, str] = {}
    shuffle: dict[str, int] = {}
    peak: dict[str, int] = {}
    for line in _event_lines(log_dir):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
            if group:
                for sid in ev.get("Stage IDs", []):
                    stage_group[sid] = group
        elif kind == "SparkListenerTaskEnd":
            group = stage_group.get(ev.get("Stage ID"))
            metrics = ev.get("Task Metrics") or {}
            if not group:
                continue
            written = (metrics.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
            shuffle[group] = shuffle.get(group, 0) + written
            peak[group] = max(peak.get(group, 0), metrics.get("Peak Execution Memory", 0))
    return {
        g: {"shuffle_bytes": shuffle.get(g, 0) // executions, "peak_task_memory_bytes": peak.get(g, 0)}
        for g in set(shuffle) | set(peak)
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = [k for k in os.environ.get("BENCH_REPORTS", "").split(",") if k]
    shuffle_partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(2 * cpus)))

    event_dir = tempfile.mkdtemp(prefix="fleetlens-events-")
    spark = build_session(
        master=f"local[{cpus}]",
        shuffle_partitions=shuffle_partitions,
        app_name="fleetlens-bench",
        extra={
            "spark.driver.memory": "16g",
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": f"file://{event_dir}",
        },
    )
    store = os.path.join(tempfile.mkdtemp(prefix="fleetlens-tables-"), "tables")

    t0 = time.perf_counter()
    write_tables(load_fixture_tables(spark, sf_dir), store)
    setup = time.perf_counter() - t0
    tables = read_tables(spark, store)

    reports = load_all()
    keys = wanted or list(reports)

    sc = spark.sparkContext

    def run_once(key: str) -> float:
        sc.setJobGroup(key, f"report {key}")
        start = time.perf_counter()
        reports[key].build(tables).write.format("noop").mode("overwrite").save()
        elapsed = time.perf_counter() - start
        sc.setJobGroup("", "")
        return elapsed

    for key in keys:  # warm-up: JIT, file listing caches, code generation
        run_once(key)
    samples: dict[str, list[float]] = {k: [] for k in keys}
    for _ in range(runs):
        for key in keys:
            samples[key].append(run_once(key))
    per_query = {k: round(statistics.median(v), 4) for k, v in samples.items()}
    total = round(sum(per_query.values()), 4)
    version = spark.version
    spark.stop()  # flushes the event log
    profile = _event_log_metrics(event_dir, runs + 1)
    print(
        json.dumps(
            {
                "metric": "sum_of_median_report_seconds",
                "value": total,
                "unit": "sec",
                "queries": per_query,
                "sf": _sf_of(sf_dir),
                "setup_derive_tables_sec": round(setup, 4),
                "runs": runs,
                "cpus": cpus,
                "spark": version,
                "shuffle_bytes": {k: profile.get(k, {}).get("shuffle_bytes", 0) for k in keys},
                "peak_task_memory_bytes": {
                    k: profile.get(k, {}).get("peak_task_memory_bytes", 0) for k in keys
                },
            }
        )
    )


if __name__ == "__main__":
    main()
