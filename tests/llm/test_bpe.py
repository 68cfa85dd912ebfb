"""BPE codec and prefix counts against the tokenizers library."""

import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import documents, messy_texts, ordered, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm import bpe_codec, token_counts
from fleetlens.llm.bpe_lexicon import Lexicon, compile_lexicon
from fleetlens.llm.bpe_model import load_blob, model_of
from fleetlens.llm.queries import tokenizer_path

PARTS = [" ", "  ", "\n", "\t", "a", "the", "'s", "'re", "'ll", "'", "!", "1", "23", "é", "<|endoftext|>", "<|", "　", "\x1c", "\x85", "日本", "😀", "foo,", " the", "\r\n", "zz", " abcdefg"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def model():
    return model_of(load_blob(tokenizer_path()))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_lexicon_is_minimal_and_finds_exactly_its_words():
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))).encode() for _ in range(300)}
    entries = [(w, list(w)) for w in words]
    lexicon = Lexicon(compile_lexicon(entries))
    assert lexicon.size == len(words)
    asked = [*words, b"abcabcabc", b"zz", b"a" * 40, *["".join(rnd.choice("abcd") for _ in range(4)).encode() for _ in range(300)]]
    found = lexicon.index(asked).tolist()
    place = {w: k for k, w in enumerate(sorted(words))}
    assert found == [place.get(w, -1) for w in asked]
    assert all(list(struct.unpack(f"<{len(w)}I", lexicon.ids_bytes(place[w]))) == list(w) for w in words)
    # Minimal: as many states as distinct sets of suffixes.
    suffixes = lambda p: frozenset(w[len(p):] for w in words if w.startswith(p))
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert lexicon.states == len({suffixes(p) for p in prefixes})
    assert Lexicon(compile_lexicon([])).index([b"", b"a"]).tolist() == [-1, -1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_encoder_equals_library(library, model, text):
    lexicon = Lexicon(bpe_codec.lexicon_of(["the", "foo,", "a\nb", "abcdefg", "<|endoftext|>"], model))
    coder = bpe_codec.Encoder(model, lexicon)
    (ids,) = coder.encode_many([text])
    want = ids_of(library, text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
    assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9).map("".join))
def test_prefix_table_equals_library_at_every_prefix(library, model, text):
    counted = token_counts.PrefixCounter(model).table(text).cumsum().tolist()
    assert counted == [len(ids_of(library, text[:k])) for k in range(1, len(text) + 1)]


def test_merge_many_equals_merge(model):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("etaoinéß日 ") for _ in range(n)).encode() for n in [*range(90), *range(40)]]
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in model.merge_many(words)] == [model.merge(w) for w in words]


def test_encode_and_decode_messy_table(spark, library):
    docs, rows = documents(spark)
    got = bpe_codec.encode(docs, tokenizer_path(), lexicon_words=20)
    want = []
    for doc_id, text, *_ in rows:
        ids = ids_of(library, text)
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert table(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(want)
    texts = bpe_codec.decode(got, tokenizer_path())
    assert table(texts, "doc_id", "text") == ordered([(r[0], r[1] or "") for r in rows])


def test_ids_do_not_depend_on_the_lexicon(spark):
    docs, _ = documents(spark)
    few, many = (bpe_codec.encode(docs, tokenizer_path(), lexicon_words=n, keep_ids=False) for n in (1, 5000))
    assert table(few, *few.columns) == table(many.repartition(7), *few.columns)


def test_frequent_words_are_those_at_or_above_a_frequency(spark):
    docs, _ = documents(spark, ["b a", "a b c", None, "", "a a c d", "x  y"], clashing=False)
    counted = dict(table(bpe_codec.word_counts(docs), "word", "n"))
    for limit in range(6):
        found = bpe_codec.frequent_words(docs, limit)
        assert len(found) <= limit and len(found) == len(set(found))
        least = min((counted[w] for w in found), default=max(counted.values()) + 1)
        assert set(found) == {w for w, n in counted.items() if n >= least}
    assert set(bpe_codec.frequent_words(docs, 1000)) == {w for w, n in counted.items() if n > 1}


def test_prefix_counts_messy_table(spark, library):
    docs, rows = documents(spark, messy_texts()[:14] + messy_texts()[18:])
    got = token_counts.prefix_counts(docs, tokenizer_path())
    want = [(r[0], len((r[1] or "").encode()), len(ids_of(library, r[1]))) for r in rows]
    assert table(got, "doc_id", "n_bytes", "n_tokens") == ordered(want)
    asked = got.select("doc_id", token_counts.tokens_at(F.lit(25)).alias("at"), token_counts.fitting_chars(F.lit(10)).alias("fit"), "n_bytes")

    def fit(text):
        return max((k for k in range(len(text) + 1) if len(ids_of(library, text[:k])) <= 10), default=0)

    want = [(r[0], len(ids_of(library, (r[1] or "")[:25])), fit(r[1] or ""), len((r[1] or "").encode())) for r in rows]
    assert table(asked, "doc_id", "at", "fit", "n_bytes") == ordered(want)


def test_packing_widens_when_a_byte_is_too_narrow():
    import numpy as np

    for values, width in (([], 1), ([127, -128], 1), ([128], 2), ([40_000], 4)):
        packed, got = token_counts._packed(np.array(values, dtype=np.int64))
        assert got == width and np.frombuffer(packed, f"<i{got}").tolist() == values


def test_empty_tables(spark):
    docs = documents(spark, [])[0]
    assert bpe_codec.encode(docs, tokenizer_path()).count() == 0
    assert token_counts.prefix_counts(docs, tokenizer_path()).count() == 0


def test_budget_in_the_same_pass_equals_the_table(spark):
    docs, _ = documents(spark)
    told = token_counts.prefix_counts(docs, tokenizer_path())
    want = told.select("doc_id", "n_tokens", token_counts.fitting_chars(F.lit(10)).alias("fit"))
    got = token_counts.prefix_counts(docs, tokenizer_path(), budget=10, keep_table=False)
    assert got.where("prefix_table is not null").count() == 0
    assert table(got, "doc_id", "n_tokens", "chars_in_budget") == table(want, "doc_id", "n_tokens", "fit")


def test_token_pairs_by_undone_merges_equal_whole_merges():
    model = model_of(load_blob(tokenizer_path()))
    counter = token_counts.PrefixCounter(model)
    rnd = random.Random(5)
    ids = sorted(model.vocab.values())
    for _ in range(20_000):
        a, b = (rnd.choice(ids[: rnd.choice([300, 5000, len(ids)])]) for _ in range(2))
        assert counter._never_merge(a, b) == (model.merge(model.token_bytes[a] + model.token_bytes[b]) == [a, b])
