"""Registered queries on the given tables, and the pipeline against brute force."""

import hashlib
import math
import struct
from collections import defaultdict

import duckdb
import pytest
from llm_cases import documents, lower_ascii, messy_texts, table, words_of
from test_curriculum import slow_targets
from test_quality import slow_bits, slow_measures
from test_simhash import brute as simhash_brute
from test_simhash import near_copies, slow_fingerprint
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF0001
from fleetlens.llm import quality, queries, secret_scan
from test_secret_scan import base_of

NAMES = list(queries.queries())


def frame(df):
    return df.toPandas()


def test_every_query_is_registered():
    assert [int(n[2:].split("_")[0]) for n in NAMES if n.startswith("op")] == list(range(1, 14))
    assert set(NAMES) | {"pipeline"} <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF0001}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = queries.queries()[name](spark, SF0001)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    close = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r)
    assert sorted(map(close, table(got, *columns)), key=key) == sorted(map(close, want.fetchall()), key=key)


def texts_of(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_op1_and_op3_equal_library(spark, con):
    library = Tokenizer.from_file(queries.tokenizer_path())
    one = {r.doc_id: r for r in queries.op1_bpe_codec(spark, SF0001).collect()}
    three = {r.doc_id: r for r in queries.op3_prefix_token_counts(spark, SF0001).collect()}
    for i, text in texts_of(con):
        ids = library.encode(text, add_special_tokens=False).ids
        assert one[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert one[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (three[i].n_bytes, three[i].n_tokens, three[i].over_limit) == (len(text.encode()), len(ids), len(ids) > 512)


def test_op6_equals_brute_force(spark, con):
    got = queries.op6_simhash_near_dedup(spark, SF0001)
    assert table(got, "doc_id", "fingerprint", "component_id") == sorted(simhash_brute(texts_of(con)))


def test_op7_base_equals_re(spark, con):
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, SF0001).collect()}
    for i, text in texts_of(con):
        base = base_of(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k, *_ in secret_scan.BASE] == [sum(b[0] == k for b in base) for k, *_ in secret_scan.BASE]
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))


def test_stages_return_the_columns_of_documents():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "bpe_encoding"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Everything but which words a cut document gives is settled by brute force."""
    texts = messy_texts() + near_copies(40) + [t.upper() for t in near_copies(6, seed=3)] + near_copies(6, seed=3)
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [r for r in rows if slow_bits(slow_measures(r[1])) & quality.CURRENT.mask == 0]
    last = {lower_ascii(r[1] or ""): r for r in left}  # the largest doc_id
    left = sorted(last.values(), key=lambda r: r[0])
    component = {i: c for i, _, c in simhash_brute(left)}
    left = [r for r in left if component[r[0]] == r[0]]
    sizes = defaultdict(int)
    for r in left:
        sizes[r[3]] += len(words_of(r[1]))
    target = slow_targets(sizes)
    assert 3 < len(left) < len(rows) - 20

    library = Tokenizer.from_file(queries.tokenizer_path())
    by_id = {r[0]: r for r in left}
    taken, whole, cut = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        _, text, _, source, _ = by_id[r.doc_id]
        ids = struct.pack(f"<{len(r.ids)}I", *r.ids)
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.n_tokens == len(r.ids)
        back = library.decode(r.ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        assert r.ids == library.encode(back, add_special_tokens=False).ids
        assert text.startswith(back)
        taken[source] += len(words_of(back))
        (whole if back == text else cut)[source] += 1
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in sizes)
    # A source cuts one document at most; a text that ends in white space is taken up to its last word.
    assert all(n <= 1 for n in cut.values())
    assert slow_fingerprint("") == 0


def test_stages_keep_extra_columns_and_survive_messy_rows(spark):
    docs, _ = documents(spark, messy_texts() + near_copies(5))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema == docs.schema, name
        assert out.count() > 0, name
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
