"""Dense ranks, top-k cuts, n-tiles and medians (B5, B6).

Every operator is one lazy plan at every size: nothing is counted or stored
while it is built. All of them work by counts over cells: a value falls into a
cell computed from the value itself (any function that never falls as the
value rises is exact), and what is known of the cells before is added.

* ``dense_rank`` deals the rows out by group and cell once and ranks them
  inside their cell; the distinct values of the cells before are added by a
  join on the same partitioning. Only a cell of more than CELL_ROWS rows (a
  value that a third of the rows share) takes another way, over its distinct
  values. Where a measure is known to have few values, ``dense_rank_of_few``
  ranks those and broadcasts them.
* ``top_dense_rank`` within groups first finds a floor below which no value can
  be among the top: the k-th of the largest values per slot, one row per group
  and map task. Only rows above it are ranked.
* ``first_ntile`` and ``median`` select by counts: the cell that holds the
  wanted place, then the value, then the id. That gives a threshold of one
  row, which filters the rows.

Expressions are written as SQL text: one call builds each, where a tree of
columns takes a call per node.

Order follows the reference dialect: descending puts nulls first, ascending
puts them last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.benchmark import attach_one_row

#: Rows of a cell that one task still ranks directly.
CELL_ROWS = 1_000_000
#: Slots per place of a top-k cut; more slots give a floor nearer to the k-th value.
SLOTS_PER_PLACE = 3
#: Cells of a dense rank per unit of the natural logarithm of 1 + |value|.
CELLS_PER_LOG = 200
#: Buckets per unit of the natural logarithm of 1 + |value|.
BUCKETS_PER_LOG = 2000
#: Ids per bucket where rows that tie are put in order of their id.
IDS_PER_BUCKET = 10_000


def sort_key(col: str, descending: bool) -> Column:
    c = F.col(col)
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def _sorted_by(col: str, descending: bool) -> str:
    return f"{col} DESC NULLS FIRST" if descending else f"{col} ASC NULLS LAST"


def _names(cols: Sequence[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}`{c}`" for c in cols)


def _within(cols: Sequence[str]) -> str:
    return f"PARTITION BY {_names(cols)}" if cols else ""


def _bucket(value: str, per_log: int) -> str:
    """SQL of the bucket of a number; a greater value never has a smaller bucket. Null for null."""
    v = f"CAST(`{value}` AS DOUBLE)"
    return f"CAST(signum({v}) * floor(log1p(abs({v})) * {per_log}) AS BIGINT)"


def value_bucket(value: str, per_log: int | None = None) -> Column:
    """Bucket of the column ``value``, ``per_log`` of them (default BUCKETS_PER_LOG) per unit of the logarithm."""
    return F.expr(_bucket(value, per_log or BUCKETS_PER_LOG))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return F.expr(" AND ".join(f"`{a}` <=> `{b}`" for a, b in zip(left, right)) or "true")


def _before(sums: str, within: Sequence[str], order: str) -> str:
    """SQL of the sum of ``sums`` over the rows before, in ``order`` within the group."""
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"coalesce(sum({sums}) OVER ({_within(within)} ORDER BY {order} {frame}), 0)"


def _attach(df: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` of ``table`` for every row of ``df``, matched on ``keys`` with nulls equal."""
    other = [f"_k{i}" for i in range(len(keys))]
    renamed = table.selectExpr(*[f"`{k}` AS {o}" for k, o in zip(keys, other)], *columns)
    return df.join(renamed, _same(keys, other)).drop(*other)


def dense_rank(
    df: DataFrame, order_col: str, rank_name: str, partition_by: Sequence[str] = (), descending: bool = True
) -> DataFrame:
    """Dense rank of every row, without gathering a rank group into one task.

    The rank of a row is its rank inside its cell (group and range of values)
    plus the distinct values of the group's cells before. The cells' counts
    are joined on the partitioning that the ranking used, so the rows move
    once. Crowded cells, at most one per CELL_ROWS rows and therefore
    broadcast, are ranked by their distinct values.
    """
    # One struct names the cell: it is equal to itself with nulls inside too, so
    # the window and the join of the counts agree on their partitioning.
    groups = [f"`{c}` AS _g{i}" for i, c in enumerate(partition_by)]
    rows = df.selectExpr("*", f"struct({', '.join([*groups, f'{_bucket(order_col, CELLS_PER_LOG)} AS _at'])}) AS _cell")
    # The group's columns are in the cell's name and need not move beside it.
    own = [c for c in df.columns if c not in partition_by]
    crowded = rows.groupBy("_cell").count().where(f"count > {CELL_ROWS}").selectExpr("_cell AS _k")
    in_crowded = F.expr("_cell = _k")
    near = rows.join(F.broadcast(crowded), in_crowded, "left_anti")
    near = near.selectExpr("*", f"dense_rank() OVER (PARTITION BY _cell ORDER BY {_sorted_by(f'`{order_col}`', descending)}) AS _place")
    far = rows.join(F.broadcast(crowded), in_crowded, "left_semi")
    far, far_values = _by_distinct_values(far, order_col, ["_cell"], descending)
    # The greatest struct has the greatest place; it asks for every column, so
    # that this aggregate reads the exchange that the ranked rows come from.
    counts = near.groupBy("_cell").agg(F.expr(f"max(struct(_place, {_names(own)}))._place AS _n"))
    counts = counts.unionByName(far_values.groupBy("_cell").agg(F.expr("CAST(count(1) AS INT) AS _n")))
    counts = counts.selectExpr("_cell AS _k", "_cell.*", "_n")
    counts = counts.selectExpr("_k", _before("_n", [f"_g{i}" for i in range(len(groups))], _sorted_by("_at", descending)) + " AS _before")
    columns = [f"`{c}`" if c in own else f"_cell._g{list(partition_by).index(c)} AS `{c}`" for c in df.columns]
    ranked = [
        part.join(counts, in_crowded).selectExpr(*columns, f"CAST(_before + _place AS BIGINT) AS `{rank_name}`")
        for part in (near, far)
    ]
    return ranked[0].unionByName(ranked[1])


def _by_distinct_values(df: DataFrame, order_col: str, group: Sequence[str], descending: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_place``, distinct values) of crowded groups: rows that tie are one value and not gathered."""
    keys, cell = [*group, order_col], [*group, "_bucket"]
    values = df.select(*keys).distinct().selectExpr("*", f"{_bucket(order_col, BUCKETS_PER_LOG)} AS _bucket")
    buckets = values.groupBy(*cell).agg(F.expr("count(1) AS _n"))
    buckets = buckets.selectExpr("*", _before("_n", group, _sorted_by("_bucket", descending)) + " AS _before")
    numbered = values.selectExpr("*", f"row_number() OVER ({_within(cell)} ORDER BY {_sorted_by(f'`{order_col}`', descending)}) AS _inside")
    placed = _attach(numbered, buckets, cell, ["_before"]).selectExpr(*[f"`{k}`" for k in keys], "_before + _inside AS _place")
    return _attach(df, placed, keys, ["_place"]), values


def dense_rank_of_few(
    df: DataFrame, order_col: str, rank_name: str, partition_by: Sequence[str] = (), descending: bool = True
) -> DataFrame:
    """Dense rank of every row by a measure of which few distinct values are possible.

    For measures with a proven bound: a rate from 0 to 100 with two digits has
    10,001 values a group; n counts that add up to N have at most sqrt(2 N).
    The distinct values are ranked and broadcast; the rows stay where they are.
    """
    keys = [*partition_by, order_col]
    rank = f"dense_rank() OVER ({_within(partition_by)} ORDER BY {_sorted_by(f'`{order_col}`', descending)})"
    values = df.select(*keys).distinct().selectExpr("*", f"CAST({rank} AS BIGINT) AS `{rank_name}`")
    return _attach(df, F.broadcast(values), keys, [f"`{rank_name}`"])


def top_dense_rank(
    df: DataFrame,
    order_col: str,
    rank_name: str,
    top: int,
    partition_by: Sequence[str] = (),
    descending: bool = True,
) -> DataFrame:
    """Rows whose dense rank is at most ``top`` (ties kept, so possibly more rows).

    The groups are calendar periods (or the whole table), so the floors, one
    row a group, and the top values, ``top`` rows a group, are broadcast; the
    rows themselves are filtered where they are.
    """
    keys = [*partition_by, order_col]
    near = _above_floor(df, order_col, top, partition_by, descending) if partition_by else df
    # Filter on the window expression itself so Catalyst recognises the
    # rank-limit pattern and inserts the partial WindowGroupLimit.
    ranked = f"dense_rank() OVER ({_within(partition_by)} ORDER BY {_sorted_by(f'`{order_col}`', descending)}) AS _rank"
    values = near.select(*keys).distinct().selectExpr("*", ranked).where(f"_rank <= {top}")
    values = values.selectExpr(*[f"`{k}`" for k in keys], f"CAST(_rank AS BIGINT) AS `{rank_name}`")
    return _attach(near, F.broadcast(values), keys, [f"`{rank_name}`"])


def _above_floor(df: DataFrame, order_col: str, top: int, partition_by: Sequence[str], descending: bool) -> DataFrame:
    """Rows that can be among the ``top`` distinct values of their group, and few others.

    Each value belongs to one slot. The best values of ``top`` slots are as
    many distinct values, so the worst of them is no better than the value at
    place ``top``: no row behind it can be in. Slots merge on the map side.
    """
    value, best, n_slots = f"`{order_col}`", "max" if descending else "min", SLOTS_PER_PLACE * top
    rows = df.selectExpr("*", f"pmod(xxhash64({value}), {n_slots}) AS _slot")
    slots = ", ".join(f"{best}(CASE WHEN _slot = {i} THEN {value} END)" for i in range(n_slots))
    # Fewer values than places leave no floor.
    nth = f"get(sort_array(filter(array({slots}), x -> x IS NOT NULL), {str(not descending).lower()}), {top - 1}) AS _floor"
    other = [f"_g{i}" for i in range(len(partition_by))]
    floors = rows.groupBy(*partition_by).agg(F.expr(nth)).selectExpr(*[f"`{k}` AS {o}" for k, o in zip(partition_by, other)], "_floor")
    joined = df.join(F.broadcast(floors), _same(partition_by, other), "left")
    # Nulls come first where the order descends; a group without a floor has few values.
    return joined.where(f"coalesce({value} {'>=' if descending else '<='} _floor, true)").select(*df.columns)


def _holding(counts: DataFrame, order: str, wanted: str, keep: Sequence[str]) -> DataFrame:
    """The one row of ``counts`` (column ``_n``) that holds the place ``wanted``.

    ``_left`` is that place counted from the row's start. The counts pass one
    task: they are those of the buckets of a table, or of what one bucket holds.
    """
    placed = counts.selectExpr("*", _before("_n", [], order) + " AS _start")
    held = placed.where(f"_start < {wanted} AND {wanted} <= _start + _n")
    return held.selectExpr(*keep, f"{wanted} - _start AS _left")


def first_ntile(df: DataFrame, measure: str, id_col: str, buckets: int, bucket_name: str) -> DataFrame:
    """Rows of the first of ``buckets`` n-tiles by ``measure`` (descending, nulls first), then ``id_col``.

    An n-tile over n rows gives the first ``n % buckets`` tiles one extra row,
    so tile 1 holds ``ceil(n / buckets)`` rows. The last of them is selected by
    counts: the bucket of values that holds it, then its value and range of
    ids, then its id. That is one row, and the rows up to it are kept.
    ``id_col`` is a whole number, distinct per row.
    """
    value, id_ = f"`{measure}`", f"`{id_col}`"
    rows = df.selectExpr("*", f"{_bucket(measure, BUCKETS_PER_LOG)} AS _bucket", f"floor({id_} / {IDS_PER_BUCKET}) AS _ids")
    one = F.expr("count(1) AS _n")
    counts = rows.groupBy("_bucket").agg(one).selectExpr("*", f"ceil(sum(_n) OVER () / {buckets}) AS _size")
    cut = _holding(counts, _sorted_by("_bucket", True), "_size", ["_bucket AS _b"])
    counts = attach_one_row(rows, cut).where("_bucket <=> _b").groupBy(F.expr(f"{value} AS _v"), "_ids", "_left").agg(one)
    cut = _holding(counts.withColumnRenamed("_left", "_size"), "_v DESC NULLS FIRST, _ids ASC NULLS LAST", "_size", ["_v", "_ids AS _i"])
    # At most IDS_PER_BUCKET rows are left, or the one with the null id.
    near = attach_one_row(rows, cut).where(f"{value} <=> _v AND _ids <=> _i")
    last = near.groupBy("_v", "_left").agg(F.expr(f"sort_array(collect_list({id_})) AS _all")).selectExpr("_v", "get(_all, CAST(_left AS INT) - 1) AS _id")
    before = f"({value} IS NULL AND _v IS NOT NULL) OR coalesce({value} > _v, false)"
    tied = f"{value} <=> _v AND (_id IS NULL OR coalesce({id_} <= _id, false))"
    kept = attach_one_row(df, last).where(f"{before} OR ({tied})")
    return kept.selectExpr(*[f"`{c}`" for c in df.columns], f"CAST(1 AS BIGINT) AS `{bucket_name}`")


def median(df: DataFrame, measure: str, name: str) -> DataFrame:
    """One row: the interpolated median of ``measure`` (nulls ignored, null for no values).

    Both middle places are selected together: the counts of the buckets give
    the one or two buckets that hold them, the counts of the values in those
    give the values.
    """
    value = f"`{measure}`"
    rows = df.where(f"{value} IS NOT NULL").selectExpr(f"{value} AS _v", f"{_bucket(measure, BUCKETS_PER_LOG)} AS _bucket")
    one = F.expr("count(1) AS _n")
    counts = rows.groupBy("_bucket").agg(one)
    counts = counts.selectExpr("*", _before("_n", [], "_bucket") + " AS _start", "(sum(_n) OVER () - 1) / 2 AS _middle")
    cut = counts.where("_start <= ceil(_middle) AND _start + _n > floor(_middle)")
    cut = cut.agg(*map(F.expr, ("min(_bucket) AS _low", "max(_bucket) AS _high", "min(_start) AS _first", "min(_middle) AS _middle")))
    held = attach_one_row(rows, cut).where("_bucket BETWEEN _low AND _high")
    # No value lies between the two buckets, so places run on from the first.
    values = held.groupBy("_v", "_first", "_middle").agg(one).selectExpr("*", "_first + " + _before("_n", [], "_v") + " AS _start")

    def at(place: str) -> str:
        return f"max(CASE WHEN _start <= {place} AND {place} < _start + _n THEN _v END) * 0.5D"

    return values.agg(F.expr(f"{at('floor(_middle)')} + {at('ceil(_middle)')} AS `{name}`"))
