"""Calendar periods and their text labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"month": ("MM", 1), "quarter": ("QUARTER", 3), "year": ("YEAR", 12)}

# Text labels and seasons as the reports define them.
# Month label: abbreviated English month, hyphen, four-digit year (e.g. Mar-2024).
MONTH_LABEL_FORMAT = "MMM-yyyy"
# Quarter label: "Q", quarter number, hyphen, year (e.g. Q1-2024); null parts are left out.
QUARTER_LABEL_PREFIX = "Q"
QUARTER_LABEL_SEPARATOR = "-"
# Season of a month number.
SEASONS = (
    ("Winter", (12, 1, 2)),
    ("Spring", (3, 4)),
    ("Summer/Pre-monsoon", (5, 6)),
    ("Monsoon/Rainy", (7, 8, 9)),
    ("Autumn/Post-monsoon", (10, 11)),
)
UNKNOWN_SEASON = "Unknown"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def period(col: Column | str, unit: str) -> Column:
    """First day of the month / quarter / year holding ``col``, as a date."""
    return F.trunc(_c(col), _UNITS[unit][0])


def period_end(start: Column, unit: str) -> Column:
    """First day of the period after the one starting at ``start`` (exclusive bound)."""
    return F.add_months(start, _UNITS[unit][1])


def in_period(col: Column | str, start: Column, unit: str) -> Column:
    """``period(col, unit) == start`` as a range predicate.

    A range on the raw column can be checked against parquet row-group
    min/max statistics and partition values; ``trunc(col) = x`` cannot.
    """
    c = _c(col)
    return (c >= start) & (c < period_end(start, unit))


def month_label(col: Column | str) -> Column:
    """Text label such as ``Mar-2024`` (null for a null date)."""
    return F.date_format(_c(col), MONTH_LABEL_FORMAT)


def quarter_label_of(year: Column, quarter: Column) -> Column:
    """``Q<quarter>-<year>`` from year and quarter numbers, skipping null parts."""
    return F.concat(
        F.lit(QUARTER_LABEL_PREFIX),
        F.coalesce(quarter.cast("string"), F.lit("")),
        F.lit(QUARTER_LABEL_SEPARATOR),
        F.coalesce(year.cast("string"), F.lit("")),
    )


def season(col: Column | str) -> Column:
    """Season name of a date's month; ``Unknown`` for a null date."""
    m = F.month(_c(col))
    expr = None
    for name, months in SEASONS:
        cond = m.isin(*months)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(UNKNOWN_SEASON))
