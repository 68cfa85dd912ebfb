"""SimHash fingerprints and components against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from llm_cases import documents, lower_ascii, messy_texts, ordered, table, words_of

from fleetlens.llm import simhash
from fleetlens.llm.components import components


def slow_fingerprint(text, size=3):
    words = words_of(lower_ascii(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, bits=3):
    """(id, fingerprint, least id reached) by comparing all pairs."""
    marks = [slow_fingerprint(r[1]) for r in rows]
    points = sorted(set(marks))
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for r, m in zip(rows, marks):
        if r[0] is not None:
            least[find(m)] = min(least.get(find(m), r[0]), r[0])
    return [(r[0], f"{m:016x}", least.get(find(m))) for r, m in zip(rows, marks)]


def near_copies(n, seed=1):
    """Texts that differ from one another by a word or two, among others."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(400)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        out.append(" ".join(words))
    return out


def test_components_of_messy_and_near_copies(spark):
    docs, rows = documents(spark, messy_texts() + near_copies(120))
    got = simhash.near_duplicates(docs)
    want = brute(rows)
    assert table(got, "doc_id", "fingerprint", "component_id") == ordered(want)
    assert len({w[2] for w in want}) < len(rows) - 20  # there are groups to find


def test_keep_one_per_component(spark):
    texts = messy_texts() + near_copies(60)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, component_id string")
    got = simhash.keep_one(docs)
    assert got.schema == docs.schema
    assert sorted(r.doc_id for r in got.collect()) == sorted({w[2] for w in brute(rows)})


def kept_of(rows):
    """(id, text) kept: of each component the least by (id is null, id, SHA-256 of the text)."""
    points = [(i, r[1]) for i, r in enumerate(rows)]
    least = {}
    for (i, text), (_, _, component) in zip(points, brute(points)):
        key = (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((text or "").encode()).digest())
        least[component] = min(least.get(component, (key, i)), (key, i))
    return ordered((rows[i][0], rows[i][1] or "") for _, i in least.values())


def test_keep_one_tells_texts_under_one_id_apart(spark):
    near = near_copies(1)[0]
    lone = " ".join(f"only{k}" for k in range(60))
    rows = [(1, near), (3, near.upper()), (3, lone)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert table(got, "doc_id", "text") == ordered([rows[0], rows[2]]) == kept_of(rows)


def test_keep_one_of_null_ids_and_repeated_rows(spark):
    near, other = near_copies(30), near_copies(30, seed=3)
    rows = [(None, t) for t in near + other] + [(7, near[0])] * 5 + [(9, near[1])] + [(None, other[0])] * 4 + [(2, None), (2, "")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered((r.doc_id, r.text or "") for r in got.collect()) == kept_of(rows)


def test_keep_one_of_messy_rows(spark):
    docs, rows = documents(spark, messy_texts() + near_copies(20))
    got = simhash.keep_one(docs)
    assert got.schema == docs.schema
    assert ordered((r.doc_id, r.text or "") for r in got.collect()) == kept_of(rows)


def test_links_join_random_points_as_all_pairs_do(spark):
    rnd = random.Random(4)
    points = {rnd.getrandbits(64) for _ in range(150)}
    for p in list(points):
        for _ in range(4):
            q = p
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                q ^= 1 << b
            points.add(q)
    signed = np.array(sorted(points), dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    unsigned = dict(zip(signed, sorted(points)))
    for bits, parts in ((3, 2), (2, 1), (1, 1)):
        found = {(r.a, r.b) for r in simhash.links(df, bits, parts).collect()}
        assert all((unsigned[a] ^ unsigned[b]).bit_count() <= bits for a, b in found)
        assert len(found) < 40 * len(points)
        all_pairs = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if (unsigned[a] ^ unsigned[b]).bit_count() <= bits}
        assert groups(found) == groups(all_pairs)


def test_crowded_cells_are_divided_without_loss(spark, monkeypatch):
    rnd = random.Random(9)
    center = rnd.getrandbits(64)
    points = {center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(500)}
    signed = np.array(sorted(points), dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    plain = groups({(r.a, r.b) for r in simhash.links(df).collect()})
    monkeypatch.setattr(simhash, "CELL_POINTS", 20)
    assert groups({(r.a, r.b) for r in simhash.links(df).collect()}) == plain


def groups(pairs):
    root = {}

    def find(p):
        root.setdefault(p, p)
        while root[p] != p:
            p = root[p]
        return p

    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for p in list(root):
        out.setdefault(find(p), set()).add(p)
    return {frozenset(g) for g in out.values()}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (7, 6)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1300)}


def test_empty_table(spark):
    docs = documents(spark, [])[0]
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0
