"""Ranked search against plain scoring of every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from fleetlens.llm import ranked_search as rs
from fleetlens.llm.ship import ship_code
from llm_cases import CLASHING, lower_ascii

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def slow(docs, items, k):
    bags = [(i, Counter(lower_ascii(t) for t in TERM.findall(text or ""))) for i, text in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            if not bag:
                continue
            m = 100 - 25 + (25 * bag.total() * n_docs) // total
            score = 0
            for t in (lower_ascii(t) for t in TERM.findall(text or "")):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def case(seed=6):
    rnd = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "été", "Été", "日本", "x1", "foo-bar", "the", "of", "rare"]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    texts = [prose(rnd.randint(0, 25)) for _ in range(120)] + ["the of"] * 70 + ["of the"] * 3 + [None, "", "§§", "only once here", "alpha " * 5000]
    rnd.shuffle(texts)
    docs = list(enumerate(texts)) + [(None, "the of"), (None, "rare"), (5, "rare rare"), (5, "rare rare")]
    items = [(i, prose(rnd.randint(1, 12))) for i in range(15)]
    items += [(20, "the the of"), (21, None), (22, ""), (23, "unknown words"), (None, "rare"), (3, "alpha"), (3, "alpha")]
    return docs, items


def frames(spark, docs, items):
    ship_code(spark)
    extra = list(dict.fromkeys(["hash", "terms", "m", "class", "rank", "score", *CLASHING]))
    left = spark.createDataFrame([(*d, *extra) for d in docs], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    return left, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, item string")


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [1, 4, 20])
def test_equals_plain_scores(spark, k):
    docs, items = case()
    left, right = frames(spark, docs, items)
    assert found(rs.search(left.repartition(3), right, k=k)) == slow(docs, items, k)


def test_blocks_of_items_and_small_batches(spark, monkeypatch):
    docs, items = case(9)
    left, right = frames(spark, docs, items)
    monkeypatch.setattr(rs, "BLOCK_TERMS", 25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert found(rs.search(left, right, k=3)) == slow(docs, items, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables(spark):
    docs, items = case()
    left, right = frames(spark, docs, items)
    assert found(rs.search(left.limit(0), right)) == []
    assert found(rs.search(left, right.limit(0))) == []
    assert found(rs.search(left.where("text is null"), right)) == []


def test_pieces_cut_between_terms(monkeypatch):
    monkeypatch.setattr(rs, "PIECE", 7)
    text = ("Alpha béta  日本 x," * 30 + "y" * 50).encode()
    assert b"".join(rs.pieces(text)) == text
    assert rs.term_counts(text) == Counter(t.encode() for t in TERM.findall(text.decode().replace("A", "a")))
    assert rs.term_counts(None) == Counter()
