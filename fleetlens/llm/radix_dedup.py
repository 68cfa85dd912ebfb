"""Exact duplicates by distributed MSD radix partitioning.

Texts are split by successive bytes, first to last. A digit is a run of bytes;
digits grow by a factor from level to level, so the number of levels is the
logarithm of the longest text. At each level the rows of a group are divided
by their next digit. A group of one row is done; so is a group whose digit is
shorter than the level's width, since its texts have ended and every byte of
them was compared. What remains goes to the next level without the bytes
already compared. No digest decides equality.

Only rows that share the first digit with another row go further, and from
there on without their other columns. Most others are known from a table of
SLOTS at most, the numbers that shared digits hash to; it is broadcast, and a
row whose number is not in it stays where it is. Counting a digit combines on
the map side, so a hot group sends one row per task, and the join that hands
out the counts splits hot keys at runtime (adaptive skew join). Levels are
stored in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.scratch import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of the first digit, and by how much each later prefix is longer.
FIRST_DIGIT, GROWTH = 256, 4
#: Numbers that first digits hash to: the bound of what is broadcast.
SLOTS = 1 << 20
_TO_END = 2**31 - 1


def normalised(text: Column) -> Column:
    """The text whose bytes are compared: A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` with its class of equal texts.

    Returns `row` (a struct of all columns of `docs`, so names never clash),
    keep_id (the largest id of the class), group_size (long) and kept.

    Exactly one row of a class has `kept`: one with the largest id (null ids
    are the smallest). Where repeated rows share that id, any one of them is
    kept. Null texts count as empty, and all empty texts are one class. Texts
    of any length are compared whole. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"))
    text = F.col(f"row.`{text_col}`")
    # Level 0: the first digit of every row, without its text. The characters
    # taken hold at least the digit's bytes.
    head = F.substring(_bytes(normalised(F.substring(text.cast("string"), 1, FIRST_DIGIT))), 1, FIRST_DIGIT)
    counted = rows.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Stored, so that the numbers given to groups are fixed.
    shared = stored(counted.select("head", F.monotonically_increasing_id().alias("_group")), "radix")
    slots = F.broadcast(shared.select(_slot(F.col("head")).alias("_slot")).distinct())
    tagged = rows.withColumn("first", head)
    apart = tagged.join(slots, _slot(F.col("first")) == F.col("_slot"), "left_anti")
    met = tagged.join(slots, _slot(F.col("first")) == F.col("_slot"), "left_semi")
    met = met.join(shared, F.col("first") == F.col("head"), "left")
    met = stored(met.select("row", "id", F.col("_group").alias("group"), F.monotonically_increasing_id().alias("tag")), "radix")

    rest = F.substring(_bytes(normalised(text)), FIRST_DIGIT + 1, _TO_END)
    level = met.where("group is not null").select("id", "group", rest.alias("rest"), "tag")
    done, width, end = [], FIRST_DIGIT * (GROWTH - 1), FIRST_DIGIT * GROWTH
    while not level.isEmpty():
        split = stored(_divided(level, width), "radix")
        done.append(split.where("ended").select(F.col("tag").alias("_tag"), "keep_id", "group_size", "kept"))
        level = split.where("not ended").select("id", "group", "rest", "tag")
        width, end = end * (GROWTH - 1), end * GROWTH
    single = (F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    out = apart.select("row", *single).unionByName(met.where("group is null").select("row", *single))
    if done:
        told = reduce(DataFrame.unionByName, done)
        out = out.unionByName(met.join(told, F.col("tag") == F.col("_tag")).select("row", "keep_id", "group_size", "kept"))
    return out


def _slot(head: Column) -> Column:
    return F.pmod(F.xxhash64(head), F.lit(SLOTS))


def _divided(level: DataFrame, width: int) -> DataFrame:
    """Each row with the group of its next digit, and whether that group is done."""
    digit = F.substring(F.col("rest"), 1, width)
    parts = level.groupBy("group", digit.alias("digit")).agg(
        F.count(F.lit(1)).alias("_size"),
        F.max(F.struct("id", "tag")).alias("_best"),
        F.max("tag").alias("_next"),
    )
    # Joined by one key of its own, not as the counts are dealt out, so that the join may split a hot group.
    parts = parts.where("_size > 1").select(F.struct("group", "digit").alias("_key"), "_size", "_best", "_next")
    joined = level.join(parts, F.struct("group", digit.alias("digit")) == F.col("_key"), "left")
    ended = F.coalesce(F.octet_length("_key.digit") < width, F.lit(True))
    return joined.select(
        "id",
        F.col("_next").alias("group"),
        F.when(~ended, F.substring(F.col("rest"), width + 1, _TO_END)).alias("rest"),
        "tag",
        ended.alias("ended"),
        F.when(F.col("_size").isNull(), F.col("id")).otherwise(F.col("_best.id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("tag") == F.col("_best.tag"), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without exact copies, with all their columns: one row of each class.

    The row with the largest id stays (null ids are the smallest; of rows that
    repeat that id, any one). Null texts are empty, and one row of all empty
    texts stays. Texts of any length are compared whole, columns of any name go
    along, an empty table gives no rows.
    """
    return classes(docs, id_col=id_col, text_col=text_col).where("kept").select("row.*")
