"""Name -> report function registry.

A report is a function ``(Tables) -> DataFrame``. It only declares a plan;
nothing runs until the caller acts on the result (collect, write, count).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from fleetlens.sources import Tables


@dataclass(frozen=True)
class Report:
    key: str
    number: int
    title: str
    build: Callable[[Tables], DataFrame]


REPORTS: dict[str, Report] = {}

_MODULES = ("drivers", "routes", "fleet", "maintenance", "fuel", "customers", "safety", "demand")


def report(key: str, number: int, title: str):
    """Register a report function under ``key``."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in REPORTS:
            raise ValueError(f"duplicate report key {key}")
        REPORTS[key] = Report(key, number, title, fn)
        return fn

    return wrap


def load_all() -> dict[str, Report]:
    for name in _MODULES:
        importlib.import_module(f"fleetlens.plans.{name}")
    return dict(sorted(REPORTS.items(), key=lambda kv: kv[1].number))


def run_report(key: str, tables: Tables) -> DataFrame:
    load_all()
    return REPORTS[key].build(tables)


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Cast decimal columns to double for consumers that do not speak decimal.

    Reports keep exact decimals to the end; this is applied only at the edge,
    after every rounding has been done in decimal.
    """
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
