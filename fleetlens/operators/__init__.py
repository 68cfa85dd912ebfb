"""Reusable DataFrame -> DataFrame operators the reports are composed of."""

from fleetlens.operators.benchmark import (
    attach_one_row,
    comparison_label,
    global_totals,
    share_of_total,
)
from fleetlens.operators.change import consecutive_rise, period_delta, with_previous
from fleetlens.operators.horizon import (
    holders_of_max,
    in_latest_period,
    inactive_members,
    latest_period_start,
    latest_value,
    since_months_before_latest,
)
from fleetlens.operators.ranking import (
    dense_rank,
    dense_rank_of_few,
    first_ntile,
    median,
    sort_key,
    top_dense_rank,
)
from fleetlens.operators.presentation import present
from fleetlens.operators.rolling import trailing_mean

__all__ = [
    "attach_one_row",
    "comparison_label",
    "consecutive_rise",
    "dense_rank",
    "dense_rank_of_few",
    "first_ntile",
    "global_totals",
    "holders_of_max",
    "in_latest_period",
    "inactive_members",
    "latest_period_start",
    "latest_value",
    "median",
    "period_delta",
    "present",
    "share_of_total",
    "since_months_before_latest",
    "sort_key",
    "top_dense_rank",
    "trailing_mean",
    "with_previous",
]
