"""SimHash near-duplicates by a segment-popcount embedding.

1. Every text gets a 64-bit fingerprint from the hashes of its word shingles.
2. Equal fingerprints are one point. A point's embedding is the number of set
   bits in each of SEGMENTS segments; one differing bit changes one coordinate
   by one, so the Manhattan distance of two embeddings is a lower bound of the
   bits in which the fingerprints differ.
3. Grid range join: the coordinates are divided into `parts` blocks. Points
   within distance k are within k // parts in at least one block, so in that
   block's grid (a cell is the block's coordinates) one of the two lies in a
   cell that the other reaches in k // parts steps. A point goes to its own
   cell and to those it reaches; no pair is listed.
4. Within a cell the fingerprints are compared by their bits, and a breadth
   first search keeps a spanning forest of the links, so a cell of n points
   gives fewer than n links whatever its density. Connected components follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bpe_codec import slices
from fleetlens.llm.components import components
from fleetlens.llm.scratch import stored

BITS, SEED = 64, 42
#: Segments of the embedding, two bits each.
SEGMENTS = 32
#: Cells of more points are divided by equal bits before their points meet.
CELL_POINTS = 20_000
#: Of this many runs of bits, k or fewer differing bits leave the rest equal.
SPARE_RUNS = 2


def fingerprint(text: str, words_in_shingle: int) -> int:
    """64-bit SimHash of the text's word shingles, repeats included.

    A-Z count as lower case; words are runs of other characters than ASCII
    white space. Fewer words than a shingle has are one shingle; no words give
    zero. A bit is set if more than half the shingles' hashes have it.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < words_in_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(words_in_shingle)]))
    counts, total, block = np.zeros(BITS, dtype=np.int64), 0, []
    for s in shingles:
        block.append(xxhash.xxh64_intdigest(s, SEED))
        if len(block) == 65_536:
            counts, total, block = counts + _set_bits(block), total + len(block), []
    if block:
        counts, total = counts + _set_bits(block), total + len(block)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _set_bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little")
    return bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "fp": pa.array(found.view(np.int64))})

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _embedding(points: np.ndarray) -> np.ndarray:
    """Set bits of each segment, one row a point."""
    width = BITS // SEGMENTS
    shifts = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(width)
    return np.bitwise_count((points[:, None] >> shifts) & np.uint64((1 << width) - 1)).astype(np.int64)


def _neighbours(cells: np.ndarray, steps: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, rows they come from) 1 to `steps` single steps away, within 0 and `top`.

    One step changes the sum of the coordinates by one, so of two cells one
    step apart that with the smaller sum reaches the other upwards, and for a
    reach of one no step downwards is needed.
    """
    level = [(cells, np.arange(len(cells)))]
    for _ in range(steps):
        further = []
        for near, rows in level:
            for k in range(near.shape[1]):
                for move in (1,) if steps == 1 else (1, -1):
                    fine = (near[:, k] + move >= 0) & (near[:, k] + move <= top)
                    moved = near[fine]
                    moved[:, k] += move
                    further.append((moved, rows[fine]))
        yield from further
        level = further


def _grid_rows(points: np.ndarray, parts: int, max_bits: int) -> tuple[np.ndarray, ...]:
    """(block, cell code, whether it is the point's own cell, index of the point) for every cell a point goes to."""
    width, top = SEGMENTS // parts, BITS // SEGMENTS
    whole = _embedding(points)
    weights = (top + 1) ** np.arange(width, dtype=np.int64)
    out = []
    for part in range(parts):
        own = whole[:, part * width : (part + 1) * width]
        near = [(own, np.arange(len(points))), *_neighbours(own, max_bits // parts, top)]
        for k, (cells, rows) in enumerate(near):
            out.append((np.full(len(rows), part), cells @ weights, np.full(len(rows), k == 0), rows))
    return tuple(map(np.concatenate, zip(*out)))


def links_among(points: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct points, by breadth-first search.

    Each point meets those not yet reached, so a dense cluster costs about its
    size, and no more than one link a point is kept.
    """
    left, out = points, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                out.extend((int(x), int(y)) for y in found.view(np.int64))
                queue.extend(found)
                left = left[~near]
    return out


def grid_cells(points: DataFrame, max_bits: int, parts: int) -> DataFrame:
    """(block, cell, home, fp): every cell that each distinct point goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                block, cell, home, owner = _grid_rows(fps.view(np.uint64), parts, max_bits)
                yield pa.RecordBatch.from_pydict({"block": pa.array(block), "cell": pa.array(cell), "home": pa.array(home), "fp": pa.array(fps[owner])})

    return points.select("fp").mapInArrow(run, "block long, cell long, home boolean, fp long")


def _forests(cells: DataFrame, max_bits: int, keys: list[str]) -> DataFrame:
    """Links (a, b) within each cell: cells are hashed to tasks, sorted there and read one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(group: np.ndarray):
            found = links_among(np.unique(group).view(np.uint64), max_bits)
            a = np.array([x for x, _ in found], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array([y for _, y in found], pa.int64())})

        open_key, open_points = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key, fps = np.stack(columns[:-1], axis=1), columns[-1]
            starts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            ends = [*starts.tolist(), len(fps)]
            at = 0
            for end in ends:
                mine = tuple(key[at])
                if mine != open_key:
                    if sum(map(len, open_points)) > 1:
                        yield linked(np.concatenate(open_points))
                    open_key, open_points = mine, []
                open_points.append(fps[at:end])
                at = end
        if sum(map(len, open_points)) > 1:
            yield linked(np.concatenate(open_points))

    columns = [*keys, "fp"]
    grouped = cells.select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInArrow(run, "a long, b long")


def _equal_runs(fp: Column, max_bits: int) -> Column:
    """Codes of the runs of bits that stay equal: each choice of SPARE_RUNS of max_bits + SPARE_RUNS runs."""
    runs = max_bits + SPARE_RUNS
    bounds = [BITS * k // runs for k in range(runs + 1)]

    def bits(k: int) -> Column:
        size = bounds[k + 1] - bounds[k]
        return F.shiftrightunsigned(fp, bounds[k]).bitwiseAND(F.lit((1 << size) - 1))

    choices = []
    for i in range(runs):
        for j in range(i + 1, runs):
            choices.append(F.struct(F.lit(i * runs + j).cast("long").alias("choice"), bits(i).alias("left"), bits(j).alias("right")))
    return F.array(*choices)


def links(points: DataFrame, max_bits: int = 3, parts: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct points within `max_bits`."""
    cells = grid_cells(points, max_bits, parts)
    filled = cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("home").alias("_home"))
    filled = filled.where("_n > 1 and _home").drop("_home")
    # A pair meets where one of the two is at home; other cells need no search.
    # Those with very many points are divided again: two points within max_bits
    # share two of the max_bits + 2 runs of bits.
    shared = cells.join(filled, ["block", "cell"])
    shared = stored(shared.select("block", "cell", "fp", (F.col("_n") > CELL_POINTS).alias("crowded")), "simhash")
    plain = _forests(shared.where("not crowded"), max_bits, ["block", "cell"])
    runs = shared.where("crowded").select("block", "cell", "fp", F.explode(_equal_runs(F.col("fp"), max_bits)).alias("run"))
    dense = runs.select("block", "cell", "run.choice", "run.left", "run.right", "fp")
    return plain.unionByName(_forests(dense, max_bits, ["block", "cell", "choice", "left", "right"]))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its fingerprint and component.

    Returns one row per row of `docs`: the id column, fingerprint (16 lowercase
    hex digits) and component_id: the least id that links of at most `max_bits`
    differing bits reach, its own included.

    Null and empty texts have fingerprint zero, which links like any other.
    Null ids take part in links; a component of null ids alone has a null
    component_id. Repeated rows and ids are kept as they come. Other columns
    are not read. Long texts are read whole, in blocks of shingles. An empty
    table gives no rows.
    """
    table = fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col)
    marked = stored(table.select(F.col(id_col).alias("id"), "fp"), "simhash")
    points = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(points, max_bits))
    # One row per distinct fingerprint from here to the last join.
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(first, "root").select(F.col("fp").alias("_fp"), "component_id")
    joined = marked.join(named, F.col("fp") == F.col("_fp"))
    return joined.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies: that with the least id, and of those the least SHA-256 of the text.

    Rows without an id come after all others. Rows are told apart by id and
    text, so of two texts under one id each stays or goes by its own component.
    Of rows that agree in both (a null text counts as empty) any one is kept.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = F.struct(docs[id_col].isNull().alias("missing"), docs[id_col].alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    found = near_duplicates(docs.select(key.alias("key"), text.alias("text")), shingle=shingle, max_bits=max_bits, id_col="key")
    lesser = (F.col("key") != F.col("component_id")).alias("lesser")
    told = found.select(F.col("key").alias("_key"), lesser).groupBy("_key", "lesser").agg(F.count(F.lit(1)).alias("_n"))
    told = stored(told.where("lesser or _n > 1"), "simhash")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    same = F.col("key") == F.col("_key")
    out = rows.join(told, same, "left_anti").select("row.*")
    again = told.where("not lesser")
    if again.isEmpty():
        return out
    # Rows that agree in id and text, reduced to one before and after the shuffle.
    return out.unionByName(rows.join(again, same, "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row.*"))
