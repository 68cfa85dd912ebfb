"""Mixing sources to target weights along a time-varying curriculum.

Only DataFrame functions. Every source gets a target number of words. Training
time runs from 0 to 1; a source's demand follows its weight schedule, a line
whose integral over all time is the target:

    demand(t) = target * (t + ramp * (t*t - t)),   -1 < ramp < 1

so a source with a positive ramp comes mostly late. A source's documents, in
the order of a hash, fill its demand one after another and, where the target
exceeds the source, in up to MOST_PASSES passes. The time at which the demand
reaches a document's first word is found by inverting the integral, and the
document's training position is the number of words that all sources have
demanded by that time. Documents are range-sorted by position.

The order within a source is a prefix sum: sums per (source, hash bucket),
sums of the buckets before, and a window inside each bucket, so a hot source
is spread over BUCKETS groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights and ramps of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
RAMPS = (-0.5, 0.0, 0.5)
MOST_PASSES = 3
#: Leading hex digits of the hash that name a bucket: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _rows(docs: DataFrame, columns: list[str], id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows with size, source and order key. `s` is the source as a key that is never null."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    name = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    return docs.select(
        F.struct(*[docs[c] for c in columns]).alias("row"),
        F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit("t")).alias("s"),
        word_count(docs[text_col]).alias("size"),
        F.md5(F.encode(F.concat(name, F.lit(":"), text), "UTF-8")).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS) -> DataFrame:
    """(s, source_size, target, ramp, total, bent) of every source, from (s, source_size).

    Sources in the order of `s` (null sources last) weigh `weights` in turn and
    share all words; a target over MOST_PASSES times its source is cut there
    and the excess reshared by weight until none is above. That is the level at
    which min(cap, weight * level) adds up to all words; for each number of
    sources at their caps, taken by rising cap / weight, the level that the
    others need is a lower bound of it, and one of them is it.

    total and bent are the same in every row: the sum of the targets, and that
    of ramp * target. The table has one row per source.
    """
    place = (F.row_number().over(Window.orderBy("s")) - 1) % len(weights)
    each = sizes.withColumn("place", place.cast("int"))
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") + 1).cast("long"))
    each = each.withColumn("ramp", F.element_at(F.array(*map(F.lit, ramps)), F.col("place") % len(ramps) + 1))
    each = each.withColumn("cap", F.col("source_size") * MOST_PASSES)
    everything = Window.partitionBy()
    lower = Window.orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    left_words = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(lower), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0))
    each = each.withColumn("level", left_words / left_weight)
    level = F.greatest(F.max("level").over(everything), F.lit(0.0))
    each = each.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level))
    return each.select(
        "s",
        "source_size",
        "target",
        "ramp",
        F.sum("target").over(everything).alias("total"),
        F.sum(F.col("ramp") * F.col("target")).over(everything).alias("bent"),
    )


def time_of(share: Column, ramp: Column) -> Column:
    """The time at which a source's demand is `share` of its target."""
    return 2 * share / ((1 - ramp) + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * share))


def assign(
    docs: DataFrame,
    *,
    columns: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The place of every row of `docs` in the mix.

    Returns `row` (a struct of `columns`, by default all), size (words),
    source_size, target, and `passes`: for each pass that takes words of the
    document its number, the words taken and the training position. The words
    of the passes of a source add up to its target, rounded down; the document
    where it is reached gives its first words only.

    Null and empty texts have size 0 and no passes. Null sources are one
    source, the last. Null ids take part like any id; repeated rows each take
    their own place, and which of two equal rows comes first makes no
    difference. An empty table gives no rows.
    """
    rows = _rows(docs, docs.columns if columns is None else columns, id_col, text_col, source_col)
    # At most BUCKETS rows a source, whatever the number of documents.
    sums = stored(rows.groupBy("s", "bucket").agg(F.sum("size").alias("bucket_size")), "curriculum")
    plan = targets(sums.groupBy("s").agg(F.sum("bucket_size").alias("source_size")))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    starts = starts.join(plan, "s").select("s", "bucket", "bucket_start", "source_size", "target", "ramp", "total", "bent")
    inside = Window.partitionBy("s", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner_start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["s", "bucket"])
    placed = placed.withColumn("start", F.col("bucket_start") + F.col("inner_start"))

    def one(k: Column) -> Column:
        offset = k * F.col("source_size") + F.col("start")
        words = F.least(F.greatest(F.floor("target") - offset, F.lit(0)), F.col("size"))
        t = time_of(F.when(words > 0, offset / F.col("target")), F.col("ramp"))
        position = F.col("total") * t + F.col("bent") * (t * t - t)
        return F.struct(k.alias("pass"), words.cast("long").alias("words"), position.alias("position"))

    every = F.transform(F.array(*[F.lit(k).cast("long") for k in range(MOST_PASSES)]), one)
    return placed.select("row", "size", "source_size", "target", F.filter(every, lambda p: p["words"] > 0).alias("passes"), "key")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    gaps = F.split(text, WORD, -1)
    size = lambda acc, x: acc + F.length(x)
    end = F.aggregate(F.slice(words, F.lit(1), n), F.lit(0), size) + F.aggregate(F.slice(gaps, F.lit(1), n), F.lit(0), size)
    return F.substring(text, F.lit(1), end)


def training_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents with the columns of `docs`, one row per pass, sorted by training position.

    A document that the mix takes twice comes twice; the document where a
    source reaches its target is cut after the words taken. Texts without
    words, null and empty ones among them, are taken by no pass and do not come.
    Null sources are one source, the last; repeated rows and null ids each take
    their own place; long texts are cut or kept whole; columns of any name go
    along; an empty table gives no rows.
    """
    placed = assign(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    each = placed.select("row", "size", "key", F.explode("passes").alias("taken"))
    text = F.col(f"row.`{text_col}`")
    words = F.col("taken.words").cast("int")
    cut = F.when(F.col("taken.words") < F.col("size"), first_words(text, words)).otherwise(text)
    columns = [cut.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    return each.orderBy("taken.position", "key").select(*columns)
