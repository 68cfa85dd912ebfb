"""Phrase index against a plain scan of every place, exact and with slop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import phrase_index as pi
from fleetlens.llm.ship import ship_code
from llm_cases import CLASHING, lower_ascii

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(lower_ascii(text or ""))


def slow(texts, items, window):
    wanted = []
    for item, text in items:
        w = words(text)
        wanted += [(item, w[s : s + window]) for s in range(max(1, len(w) - window + 1)) if w]
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for item, phrase in wanted:
            for s in range(len(w) - len(phrase) + 1):
                if w[s : s + len(phrase)] == phrase:
                    hit |= set(range(s, s + len(phrase)))
                    found.add("" if item is None else str(item))
        out.append((len(w), len(hit), len(found), sorted(found), bool(hit)))
    return out


def case(seed=2):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "The", "été", "ÉTÉ", "x1", "日本", "b-c", "a", "z"]

    def prose(n, extra=()):
        return " ".join(rnd.choice([*vocabulary, *extra]) for _ in range(n))

    items = [(i, prose(rnd.randint(6, 20), ["rare", "odd"])) for i in range(12)]
    items += [(20, "one two"), (21, "solo"), (22, None), (23, ""), (None, "null item here"), (3, "the same id again"), (24, "a a a a a a a"), (25, "never seen anywhere at all")]
    texts = [prose(rnd.randint(0, 60), ["one", "two", "rare"]) for _ in range(40)]
    for i, text in items:
        if text:
            cut = text.split(" ")
            texts += [f"{prose(5)}, {text.upper() if i == 1 else text}; {prose(9)}", " ".join(cut[:-1]), " ".join(cut[1:5])]
    texts += [None, "", "  ", "solo", "Solo one TWO solo", "a " * 400, items[0][1] + " " + items[0][1], texts[0], texts[0]]
    return texts, items


def frames(spark, texts, items):
    ship_code(spark)
    extra = list(dict.fromkeys(["tag", "place", "term", "head", "words", "n_hit", *CLASHING]))
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(i, t, *extra) for i, t in enumerate(texts)], schema)
    return docs, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, phrase string")


@pytest.mark.parametrize("window", [1, 4, 10])
def test_equals_scan(spark, window):
    texts, items = case()
    docs, bench = frames(spark, texts, items)
    got = pi.decontaminate(docs.repartition(3), bench, window=window, columns=["doc_id", "tag"]).collect()
    got = sorted((r.row.doc_id, (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated)) for r in got)
    assert got == list(enumerate(slow(texts, items, window)))


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    texts, items = case(8)
    docs, bench = frames(spark, texts, items)
    monkeypatch.setattr(pi, "HELD_ROWS", 0)
    monkeypatch.setattr(pi, "SLOTS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = pi.decontaminate(docs, bench, window=4).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = sorted((r.row.doc_id, (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated)) for r in got)
    assert got == list(enumerate(slow(texts, items, 4)))


@pytest.mark.parametrize("slop", [1, 3])
def test_proximity_equals_scan(spark, slop):
    texts, items = case(4)
    docs, bench = frames(spark, texts, items)
    index = pi.PhraseIndex(docs, pi.phrases(bench, window=4), columns=["doc_id"])
    ranked = {}
    for r in index.ranked.collect():
        ranked.setdefault(r.phrase_id, {})[r["rank"]] = r
    named = {r.phrase_id: [x.word for x in sorted(r.words, key=lambda x: x.offset)] for r in _phrase_words(index)}
    want = set()
    for d, text in enumerate(texts):
        w = words(text)
        for phrase, ranks in ranked.items():
            first = ranks[1]
            for at, word in enumerate(w):
                if word != named[phrase][first.offset]:
                    continue
                start = at - first.offset
                others = [o for o in range(first.length) if o != first.offset]
                if all(any(0 <= start + o + s < len(w) and w[start + o + s] == named[phrase][o] for s in range(-slop, slop + 1)) for o in others):
                    want.add((d, phrase, start))
    rows = index.rows().select("tag", "row.doc_id")
    got = {(r.doc_id, r.phrase_id, r.start) for r in index.matches(slop).join(rows, "tag").collect()}
    assert got == want
    exact = {(r.doc_id, r.phrase_id, r.start) for r in index.matches().join(rows, "tag").collect()}
    assert exact < got


def _phrase_words(index):
    words_of = index.phrases.select("phrase_id", F.posexplode("phrase").alias("offset", "word"))
    return words_of.groupBy("phrase_id").agg(F.collect_list(F.struct("offset", "word")).alias("words")).collect()


def test_empty_tables(spark):
    texts, items = case()
    docs, bench = frames(spark, texts, items)
    assert pi.decontaminate(docs.limit(0), bench).count() == 0
    got = pi.decontaminate(docs, bench.limit(0), columns=["doc_id"]).collect()
    assert len(got) == len(texts) and not any(r.contaminated or r.n_hit or r["items"] for r in got)


def test_very_long_text(spark):
    items = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    long = "w1 filler " * 400_000 + items[0][1] + " end"
    docs, bench = frames(spark, [long, "w1 w2"], items)
    got = sorted((r.row.doc_id, r.n_words, r.n_hit) for r in pi.decontaminate(docs, bench, columns=["doc_id"]).collect())
    assert got == [(0, 800_012, 11), (1, 2, 0)]


def test_plan_has_no_python(spark, capsys):
    texts, items = case()
    docs, bench = frames(spark, texts, items)
    index = pi.PhraseIndex(docs, pi.phrases(bench), columns=["doc_id"])
    index.matches().join(index.rows(), "tag").explain()
    assert "Python" not in capsys.readouterr().out
