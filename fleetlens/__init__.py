"""fleetlens: trucking-operations reports as Spark DataFrame plans.

Layout
------
``sources``    logical table schemas, loaders, and the adapter that derives the
               eight logical tables from the TPC-H-like fixture tables.
``functions``  column expressions: exact decimal ratios and means, calendar
               periods and labels.
``operators``  reusable DataFrame -> DataFrame building blocks (period-over-
               period change, ranking, trailing means, benchmarks, shares,
               horizons).
``plans``      the 59 named reports, grouped by subject, and the registry.
``llm``        training-data operators over documents and pages (optional:
               nothing else imports it).
"""

from fleetlens.sources import Tables, load_fixture_tables, read_tables, write_tables
from fleetlens.plans.registry import load_all, run_report

__all__ = [
    "Tables",
    "load_all",
    "load_fixture_tables",
    "read_tables",
    "run_report",
    "write_tables",
]
