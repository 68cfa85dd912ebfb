"""Trailing means over present periods (B7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from fleetlens.functions.exact import COUNT, ratio
from fleetlens.operators.change import by_entity


def trailing_mean(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    measure: str,
    out_name: str,
    rows: int,
    scale: int,
    num_type: DecimalType = DecimalType(30, 2),
) -> DataFrame:
    """Mean of ``measure`` over the current row and the ``rows - 1`` rows before it.

    The frame counts present rows, not calendar months (a gap is skipped).
    Nulls are left out of both the sum and the count, like ``AVG``. The window
    is partitioned by entity, so a task holds one entity's periods.
    """
    w = (
        Window.partitionBy(*keys)
        .orderBy(F.col(time_col).asc_nulls_last())
        .rowsBetween(-(rows - 1), Window.currentRow)
    )
    m = F.col(measure)
    return by_entity(df, keys).withColumn(
        out_name,
        ratio(F.sum(m).over(w), F.count(m).over(w), scale, num_type=num_type, den_type=COUNT),
    )
