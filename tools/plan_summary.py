"""Summarise every report's physical plan as it would run at scale.

Broadcast joins are switched off (``autoBroadcastJoinThreshold=-1``) so that
every fact-to-fact join shows the sort-merge join and shuffles it would use on
a cluster, where those sides are far above any broadcast threshold; the
explicit one-row broadcasts stay. For each report the script counts the
shuffles by kind and lists window partitioning, top-k pruning and scan
pushdown, and writes a markdown table (default PLANS.md).

Usage: python tools/plan_summary.py [sf_dir] [out.md]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from fleetlens.plans.registry import load_all  # noqa: E402
from fleetlens.session import build_session  # noqa: E402
from fleetlens.sources import load_fixture_tables, read_tables, write_tables  # noqa: E402


def summarise(plan: str) -> dict[str, str]:
    hash_ex = len(re.findall(r"Exchange hashpartitioning", plan))
    range_ex = len(re.findall(r"Exchange rangepartitioning", plan))
    single = len(re.findall(r"Exchange SinglePartition", plan))
    round_robin = len(re.findall(r"Exchange RoundRobinPartitioning\(1\)|Exchange SinglePartition, REPARTITION", plan))
    bcast = len(re.findall(r"BroadcastExchange", plan))
    smj = len(re.findall(r"SortMergeJoin", plan))
    bnlj = len(re.findall(r"BroadcastNestedLoopJoin", plan))
    windows = set()
    for line in plan.splitlines():
        node = line.strip().lstrip("+-: ")
        if not node.startswith("Window ["):
            continue
        # "Window [exprs], [partition keys], [order keys]"; the partition part is
        # omitted for an unpartitioned window.
        parts = node.split("], [")
        windows.add(re.sub(r"#\d+L?", "", parts[1]) if len(parts) >= 3 else "(none: bounded input)")
    win = "; ".join(sorted(windows)) or "-"
    return {
        "hash shuffles": str(hash_ex),
        "range sorts": str(range_ex),
        "single-partition": str(single + round_robin),
        "sort-merge joins": str(smj),
        "broadcasts": f"{bcast} ({bnlj} one-row)" if bnlj else str(bcast),
        "window partitions": win,
        "top-k cut": "yes" if "WindowGroupLimit" in plan else "",
        "subquery in scan": "yes" if re.search(r"PushedFilters: \[[^\]]*ScalarSubquery", plan) else "",
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else os.path.join(ROOT, "PLANS.md")
    spark = build_session("local[4]", shuffle_partitions=200, app_name="fleetlens-plans")
    store = tempfile.mkdtemp(prefix="fleetlens-plan-tables-")
    write_tables(load_fixture_tables(spark, sf_dir), store)
    tables = read_tables(spark, store)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    reports = load_all()
    rows = []
    for key, rep in reports.items():
        df = rep.build(tables)
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows.append((f"Q{rep.number:02d}", key, summarise(plan)))
    cols = list(rows[0][2])
    lines = [
        "# Report plans at scale",
        "",
        "Generated by `tools/plan_summary.py` with broadcast joins off (as for fact tables on a",
        "cluster). Counts are physical-plan nodes before adaptive re-planning; one-row",
        "broadcasts are the global aggregates attached to every row. Window partitions name",
        "the keys each window task holds; `(none: bounded input)` marks an unpartitioned",
        "window over months, seasons, value buckets or the values left by a top-k cut.",
        "",
        "| id | report | " + " | ".join(cols) + " |",
        "| --- | --- | " + " | ".join("---" for _ in cols) + " |",
    ]
    for num, key, summ in rows:
        lines.append(f"| {num} | `{key}` | " + " | ".join(summ[c] for c in cols) + " |")
    lines += [
        "",
        "## What bounds each single-task step",
        "",
        "- `month` windows in Q04 and Q21 and the unpartitioned windows in Q05, Q36, Q37 and",
        "  Q49 run over counts per value bucket; there are at most about 80,000 buckets for",
        "  amounts up to 1e18, whatever the number of drivers, trucks or routes.",
        "- Entity windows (`driver_id`, `truck_id`, `route_id`, `customer_id`) hold one entity's",
        "  periods: at most the number of months in the data.",
        "- Unpartitioned windows elsewhere run over one row per month, quarter or season, or",
        "  over the top values that each task kept.",
        "- Single-partition exchanges are global aggregates (one row), scalar subqueries (one",
        "  value), and the final sort of results bounded by periods or seasons.",
        "- Range sorts are the final ORDER BY of results with one row per driver, truck,",
        "  customer or route (distributed); where a lag or a trailing mean comes first, one",
        "  range exchange on the entity serves it and the sort.",
    ]
    with open(out, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
