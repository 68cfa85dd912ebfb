"""Targets, words taken and positions of the mix against plain Python."""

import math
from collections import defaultdict

import pytest
from llm_cases import documents, messy_texts, words_of
from pyspark.sql import functions as F

from fleetlens.llm import curriculum


def slow_targets(sizes):
    """Share by weight, cut at three times the size, share the excess again until none is above."""
    names = sorted(n for n in sizes if n is not None) + ([None] if None in sizes else [])
    weight = {n: (1, 2, 3)[k % 3] for k, n in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total > 3 * sizes[n]}
        if not over:
            return out | {n: left * weight[n] / total for n in open_}
        for n in over:
            out[n] = 3.0 * sizes[n]
        left, open_ = left - sum(3 * sizes[n] for n in over), open_ - over
    return out


def sizes_of(rows):
    out = defaultdict(int)
    for r in rows:
        out[r[3]] += len(words_of(r[1]))
    return out


@pytest.mark.parametrize("scale", [1, 30])
def test_targets_and_taken(spark, scale):
    texts = messy_texts() + ["word " * 50 * k for k in range(scale)]
    docs, rows = documents(spark, texts)
    sizes = sizes_of(rows)
    want = slow_targets(sizes)
    got = curriculum.assign(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "passes").collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        words = sum(p.words for p in r.passes)
        taken[r.source] += words
        assert 0 <= words <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        times = [p.position for p in r.passes]
        assert times == sorted(times)
    for s in sizes:
        assert taken[s] == math.floor(want[s] + 1e-9)


def test_small_sources_are_cut_and_the_excess_is_shared_again(spark):
    rows = [("a", 1000), ("b", 10), ("c", 10), ("d", 10), ("e", 0)]
    sums = spark.createDataFrame([("s" + n, v) for n, v in rows], "s string, source_size long")
    got = {r.s[1:]: r.target for r in curriculum.targets(sums).collect()}
    assert got == pytest.approx(slow_targets(dict(rows))) and got["b"] == 30 and sum(got.values()) == pytest.approx(1030)


def test_time_inverts_demand(spark):
    points = spark.createDataFrame([(k / 50, r) for k in range(51) for r in (-0.9, -0.5, 0.0, 0.5, 0.9)], "u double, ramp double")
    t = curriculum.time_of(F.col("u"), F.col("ramp"))
    for r in points.select("u", "ramp", t.alias("t")).collect():
        assert r.t + r.ramp * (r.t * r.t - r.t) == pytest.approx(r.u) and -1e-9 <= r.t <= 1 + 1e-9


def test_late_sources_come_late(spark):
    rows = [(i, "w " * 20, "en", s) for i, s in enumerate(["a", "b", "c"] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    order = [r.source for r in curriculum.training_order(docs).collect()]
    mean = {s: sum(k for k, x in enumerate(order) if x == s) / order.count(s) for s in "abc"}
    assert mean["a"] < mean["b"] < mean["c"]


def test_training_order_repeats_and_cuts(spark):
    docs, rows = documents(spark)
    got = curriculum.training_order(docs)
    assert got.schema == docs.schema
    found = got.select("source", "text").collect()
    taken = defaultdict(int)
    for r in found:
        assert words_of(r.text)
        taken[r.source] += len(words_of(r.text))
    want = slow_targets(sizes_of(rows))
    assert all(taken[s] == math.floor(v + 1e-9) for s, v in want.items())


def test_reruns_agree_however_rows_are_dealt(spark):
    docs, _ = documents(spark)
    runs = [sorted(str(r) for r in curriculum.assign(d, columns=["doc_id"]).select("row.doc_id", "size", "target", "passes").collect()) for d in (docs, docs.repartition(9))]
    assert runs[0] == runs[1]


def test_first_words(spark):
    text = " a  bb\nccc dd "
    got = spark.createDataFrame([(text, n) for n in (1, 2, 3, 4)], "t string, n int").select(curriculum.first_words(F.col("t"), F.col("n")).alias("x"))
    assert [r.x for r in got.collect()] == [" a", " a  bb", " a  bb\nccc", " a  bb\nccc dd"]


def test_empty_tables_and_textless_sources(spark):
    docs = documents(spark, [])[0]
    assert curriculum.assign(docs).count() == 0 and curriculum.training_order(docs).count() == 0
    docs = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r.target, len(r.passes)) for r in curriculum.assign(docs).collect()) == [(0.0, 0), (0.0, 0)]


def test_no_python_in_the_plan(spark):
    docs, _ = documents(spark, ["a b", "c"])
    plan = curriculum.assign(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
