"""Period-over-period change (B4) and consecutive rises (B11).

``lag`` steps over *present* rows: when an entity has no row for a month, its
"previous month" is the last month it does have. The calendar is never
densified. The window is partitioned by the entity, so each window task holds
one entity's periods (bounded by the number of periods), never a whole table.

Entities are dealt out by range, not by hash: the range partitioning serves
the window and a final sort that begins with the entity (nulls last) alike,
so the sort needs no exchange of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(keys: Sequence[str], time_col: str):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    # Null periods sort last in ascending order, as in the reference dialect.
    return w.orderBy(F.col(time_col).asc_nulls_last())


def by_entity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range-partition by the entity, as the window and an ORDER BY of the entity both need."""
    return df.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys]) if keys else df


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    columns: dict[str, tuple[str, int]],
) -> DataFrame:
    """Add ``new_name = lag(source, offset)`` per entity ordered by ``time_col``.

    ``columns`` maps each new column name to ``(source column, offset)``.
    All lags share one window, so Spark evaluates them in a single Window
    operator over one shuffle.
    """
    w = _window(keys, time_col)
    return by_entity(df, keys).select(
        "*",
        *[F.lag(F.col(src), offset).over(w).alias(name) for name, (src, offset) in columns.items()],
    )


def period_delta(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    measure: str,
    prev_name: str,
    change_name: str | None = None,
    *,
    keep_first: bool = True,
    change_scale: int | None = None,
) -> DataFrame:
    """Previous value of ``measure`` and the change from it.

    ``keep_first=False`` drops rows whose previous value is null (the first
    period of each entity, and any period after a null measure), exactly as a
    ``WHERE prev IS NOT NULL`` over the lagged rows would.
    """
    out = with_previous(df, keys, time_col, {prev_name: (measure, 1)})
    if change_name:
        change: Column = F.col(measure) - F.col(prev_name)
        if change_scale is not None:
            change = F.round(change, change_scale)
        out = out.withColumn(change_name, change)
    if not keep_first:
        out = out.where(F.col(prev_name).isNotNull())
    return out


def consecutive_rise(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    measure: str,
    prev_names: Sequence[str],
    months: int,
) -> DataFrame:
    """Rows whose measure rose over each of the last periods, from ``months`` before the latest period on.

    ``prev_names[i]`` receives ``lag(measure, i + 1)``. The lags are taken over
    the entity's full history *before* the recency filter, so the first kept
    month still sees the months before.

    The latest period is that of ``df`` itself. It is the time of the greatest
    row that begins with the time: asking for whole rows keeps the plan below
    the same as that of the rows, so both read one shuffle of ``df``.
    """
    lags = {name: (measure, i + 1) for i, name in enumerate(prev_names)}
    out = with_previous(df, keys, time_col, lags)
    rest = [c for c in df.columns if c != time_col]
    greatest = F.max(F.struct(time_col, *rest))[time_col]
    since = df.agg(F.add_months(greatest, -months)).scalar()
    chain = [measure, *prev_names]
    cond = F.col(time_col) >= since
    for newer, older in zip(chain, chain[1:]):
        cond = cond & (F.col(newer) > F.col(older))
    return out.where(cond)
