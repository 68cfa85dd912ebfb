"""Independent DuckDB SQL for every report, over the fixture views.

Each query is written from the report's definition, with exact decimal
rounding done in integer arithmetic (``sqlkit``), so it can check the Spark
plans value for value.
"""

from __future__ import annotations

import importlib

from oracle.tables import with_tables

_MODULES = ("drivers", "routes", "fleet", "maintenance", "fuel", "customers", "safety", "demand")


def oracle_queries() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in _MODULES:
        try:
            mod = importlib.import_module(f"oracle.{name}")
        except ModuleNotFoundError as exc:
            if exc.name != f"oracle.{name}":
                raise
            continue
        for key, body in mod.SQL.items():
            out[key] = with_tables(body)
    return out


def oracle_bodies() -> dict[str, str]:
    """The report queries without the fixture-derivation CTEs.

    They read tables named like the logical tables, so they also run on any
    DuckDB connection holding those eight tables (used by the micro tests).
    """
    out: dict[str, str] = {}
    for name in _MODULES:
        mod = importlib.import_module(f"oracle.{name}")
        out.update({key: body.strip() for key, body in mod.SQL.items()})
    return out
