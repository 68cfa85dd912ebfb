"""Ranked lexical search of all documents for each item, by bag deduplication.

For a block of items a document matters only by the counts of the items' terms
in it and by m, its length against the mean. Documents are reduced to that
vector (terms, counts, m) where their text is read. Equal vectors are one
class: they meet by their hash and are told apart by their values. A class is
scored once, whatever the number of its members, and only the classes that
win a place are expanded, members by ascending id.

A class needs no more than its k least ids, and the window that keeps them is
cut before the shuffle, so a hot class sends k rows a task. If a class has a
member among the k best documents, its least member is there too; so the k
best classes by (score, least id) hold the k best documents.

Items go to the workers in blocks of about BLOCK_TERMS terms, the bound of
what the driver and a worker hold of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.phrase_index import words
from fleetlens.llm.scratch import stored

#: Terms of all items of a block, about.
BLOCK_TERMS = 200_000
#: Bytes of a text whose words are listed at once.
PIECE = 1 << 22
# In UTF-8 every byte of a character beyond ASCII is 0x80 or more, and bytes.lower() touches A-Z only.
_TERM, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_LAST = np.iinfo(np.int64).max

RESULT = "item_id {id}, rank int, doc_id long, score long"
_BAG = "doc_id long, n long, terms array<int>, counts array<int>"
_WON = "item int, class long, score long, least long"


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes, cut between terms."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def term_counts(text: bytes | None) -> Counter:
    counts: Counter = Counter()
    for piece in pieces(text or b""):
        counts.update(_TERM.findall(piece.lower()))
    return counts


def _lists(values: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.fromiter((x for v in values for x in v), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _bag_maker(number: dict[bytes, int]):
    """Batches of (doc_id, text) to batches of bags over the numbered terms."""

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                bag = term_counts(text.as_py())
                held = sorted((number[t], bag[t]) for t in bag.keys() & number.keys())
                sizes.append(bag.total())
                terms.append([t for t, _ in held])
                counts.append([c for _, c in held])
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), _lists(terms), _lists(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    return bags


def class_scores(queries: list[tuple[np.ndarray, np.ndarray]], k: int):
    """Batches of classes to the best k classes of each item: (item, class, score, least).

    ``queries`` holds per item its term numbers and their weights times repeats.
    """

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            terms, counts = batch.column("terms"), batch.column("counts")
            row = np.repeat(np.arange(len(batch)), np.diff(terms.offsets.to_numpy()))
            term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            m = batch.column("m").to_numpy()
            part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
            # Postings by term: each item adds up the lists of its terms.
            order = np.argsort(term, kind="stable")
            term, row, part = term[order], row[order], part[order]
            ids = batch.column("class").to_numpy()
            least = batch.column("least").fill_null(_LAST).to_numpy()
            for item, (wanted, weights) in enumerate(queries):
                score = np.zeros(len(batch), dtype=np.int64)
                starts, ends = np.searchsorted(term, wanted), np.searchsorted(term, wanted, side="right")
                for weight, a, b in zip(weights, starts, ends):
                    score[row[a:b]] += weight * part[a:b]
                held = best.get(item)
                floor = max(1, int(held[0][-1])) if held is not None and len(held[0]) == k else 1
                if len(score) > k:
                    floor = max(floor, int(np.partition(score, -k)[-k]))
                near = np.flatnonzero(score >= floor)
                if not len(near):
                    continue
                found = (score[near], least[near], ids[near])
                if held is not None:
                    found = tuple(np.concatenate(pair) for pair in zip(held, found))
                first = np.lexsort((found[2], found[1], -found[0]))[:k]
                best[item] = tuple(x[first] for x in found)
        items = [np.full(len(v[0]), item, dtype=np.int32) for item, v in best.items()]
        if items:
            score, least, ids = (np.concatenate(x) for x in zip(*best.values()))
            columns = [pa.array(np.concatenate(items)), pa.array(ids), pa.array(score), pa.array(least, mask=least == _LAST)]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "class", "score", "least"])

    return scored


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0.

    Scores fall with the rank; equal scores go by ascending document id, null
    ids last. Document ids are whole numbers. Each row of ``items`` is an item,
    also where ids repeat or are null, and each row of ``docs`` a document of
    its own. Null and empty texts have no terms: such a document is never
    found, such an item finds nothing. Texts of any length are read whole.
    Without documents or without items there are no rows.
    """
    spark = docs.sparkSession
    wanted, blocks = _items(items, item_col, item_text_col)
    found = [_block(docs, wanted.where(F.col("block") == b), k, id_col, text_col) for b in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], RESULT.format(id=items.schema[item_col].dataType.simpleString()))
    ranked = reduce(DataFrame.unionByName, found)
    names = wanted.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _items(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows (item, item_id, word, repeats, block), stored, and the number of blocks."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("_words"))
    # The numbers of items are fixed before their words are grouped.
    rows = stored(rows, "items").select("item", "item_id", F.explode("_words").alias("word"))
    counted = stored(rows.groupBy("item", "item_id", "word").agg(F.count(F.lit(1)).alias("repeats")), "item-terms")
    blocks = math.ceil(counted.count() / BLOCK_TERMS)
    return counted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))), blocks


def _block(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(item, rank, doc_id, score) of one block of items; None if nothing is found."""
    held = wanted.select("item", "word", "repeats").collect()
    number = {w: i for i, w in enumerate(sorted({r.word for r in held}))}
    numbered = {w.encode(): i for w, i in number.items()}
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bags = stored(texts.mapInArrow(_bag_maker(numbered), _BAG), "bags")
    total, n_docs = bags.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    if not total:
        return None
    seen = dict(bags.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in seen.items()}
    classes = _classes(bags, n_docs, total, k)

    tags = sorted({r.item for r in held})
    place = {tag: i for i, tag in enumerate(tags)}
    asked: list[list[tuple[int, int]]] = [[] for _ in tags]
    for r in held:
        term = number[r.word]
        if weight.get(term):
            asked[place[r.item]].append((term, weight[term] * r.repeats))
    queries = [(np.array([t for t, _ in q], dtype=np.int32), np.array([w for _, w in q], dtype=np.int64)) for q in asked]
    won = classes.select("class", "terms", "counts", "m", "least").mapInArrow(class_scores(queries, k), _WON)
    order = [F.col("score").desc(), F.col("least").asc_nulls_last(), F.col("class")]
    first = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    won = stored(won.withColumn("place", first).where(F.col("place") <= k), "won")
    return _expanded(won, classes, tags, k)


def _classes(bags: DataFrame, n_docs: int, total: int, k: int) -> DataFrame:
    """(class, terms, counts, m, least, members): the classes of equal bags, with their ``k`` least ids."""
    m = F.expr(f"100 - 25 + (25L * n * {n_docs}L) div {total}L").alias("m")
    vectors = bags.where(F.size("terms") > 0).select("doc_id", "terms", "counts", m)
    key = ["hash", "terms", "counts", "m"]
    vectors = vectors.withColumn("hash", F.xxhash64("terms", "counts", "m"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last()))
    # Filtered by the place alone, so that the cut is made before the shuffle too.
    kept = vectors.withColumn("place", place).where(F.col("place") <= k)
    members = F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda s: s["doc_id"])
    grouped = kept.groupBy(*key).agg(members.alias("members"))
    return stored(grouped.select(F.monotonically_increasing_id().alias("class"), "terms", "counts", "m", F.get("members", F.lit(0)).alias("least"), "members"), "classes")


def _expanded(won: DataFrame, classes: DataFrame, tags: list[int], k: int) -> DataFrame:
    """The members of the classes that won, ranked per item."""
    spark = won.sparkSession
    names = spark.createDataFrame(list(enumerate(tags)), "item int, _tag long")
    rows = won.join(classes.select("class", "members"), "class").select("item", "score", F.explode("members").alias("doc_id"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(names, "item").select(F.col("_tag").alias("item"), "rank", "doc_id", "score")
