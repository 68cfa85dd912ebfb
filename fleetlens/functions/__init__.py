"""Column expressions shared by the reports."""

from fleetlens.functions.calendar import (
    in_period,
    month_label,
    period,
    period_end,
    quarter_label_of,
    season,
)
from fleetlens.functions.exact import (
    AMOUNT,
    COUNT,
    FIXED,
    SMALL_AMOUNT,
    compare_to_mean,
    diff_from_mean,
    mean,
    ratio,
)

__all__ = [
    "AMOUNT",
    "COUNT",
    "FIXED",
    "SMALL_AMOUNT",
    "compare_to_mean",
    "diff_from_mean",
    "in_period",
    "mean",
    "month_label",
    "period",
    "period_end",
    "quarter_label_of",
    "ratio",
    "season",
]
