"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b; long), root the least node of its component.

    Each round replaces edges by edges to smaller nodes: the large star links a
    node's greater neighbours to its least neighbour, the small star its
    smaller ones. Both keep the components and at most the number of edges,
    and the rounds end when nothing changes. A hub's least neighbour is a
    map-side minimum; the join that hands it out splits hot keys at runtime.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = stored(pairs.where("a != b").distinct(), "components")
    seen = _mark(pairs)
    while True:
        pairs = stored(_small_star(_large_star(pairs)), "components")
        mark = _mark(pairs)
        if mark == seen:
            break
        seen = mark
    # Now every edge leads from a node to its root.
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    """Number and sums of the edges: equal for equal sets of edges."""
    return tuple(
        pairs.agg(
            F.count(F.lit(1)),
            F.sum(F.col("b").cast("decimal(20,0)")),
            F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")),
        ).first()
    )


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_least"))
    linked = both.join(least, F.col("a") == F.col("_a"))
    least = F.least("a", "_least")
    return linked.where("b > a").select(F.col("b").alias("a"), least.alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_least"))
    linked = pairs.join(least, F.col("a") == F.col("_a"))
    moved = linked.where("b != _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return moved.unionByName(least.select(F.col("_a").alias("a"), F.col("_least").alias("b"))).distinct()
