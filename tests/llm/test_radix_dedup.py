"""Exact dedup against grouping in plain Python."""

from collections import defaultdict

from llm_cases import documents, lower_ascii, messy_texts, ordered, table

from fleetlens.llm import radix_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower_ascii(r[1] or "")].append(r[0])
    return groups


def test_classes_of_messy_rows(spark):
    docs, rows = documents(spark)
    got = radix_dedup.classes(docs)
    groups = brute(rows)
    want = []
    for r in rows:
        ids = groups[lower_ascii(r[1] or "")]
        known = [i for i in ids if i is not None]
        want.append((r[0], r[1], max(known) if known else None, len(ids)))
    assert table(got, "row.doc_id", "row.text", "keep_id", "group_size") == ordered(want)
    # Exactly one row of each class stays, and it has the class's largest id.
    kept = got.where("kept").select("row.doc_id", "row.text", "keep_id").collect()
    assert sorted(lower_ascii(r.text or "") for r in kept) == sorted(groups)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_prefixes_at_digit_borders_are_told_apart(spark):
    texts = [c * n for c in "ab" for n in (63, 64, 65, 255, 256, 257, 1023, 1024, 1025, 4096, 4097)] * 2
    texts += ["é" * 32, "é" * 31 + "è", "é" * 128, "é" * 127 + "è"] * 2
    docs, rows = documents(spark, texts, clashing=False)
    sizes = {k: len(v) for k, v in brute(rows).items()}
    got = radix_dedup.classes(docs).select("row.text", "group_size").collect()
    assert all(r.group_size == sizes[lower_ascii(r.text or "")] for r in got) and len(got) == len(rows)


def test_hot_copies_and_deduplicate_keeps_columns(spark):
    texts = ["The same long text " * 200] * 300 + messy_texts()
    docs, rows = documents(spark, texts)
    got = radix_dedup.deduplicate(docs)
    assert got.schema == docs.schema
    assert got.count() == len(brute(rows))


def test_empty_table(spark):
    docs = documents(spark, [])[0]
    assert radix_dedup.classes(docs).count() == 0 and radix_dedup.deduplicate(docs).columns == docs.columns
