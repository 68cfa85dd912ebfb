"""Conversation repair against a plain search over edits, and its block tables."""

import hashlib
import random
import sys
import zlib
from functools import lru_cache

import duckdb
from conftest import SF001
from fleetlens.llm import conversation_repair as cr
from fleetlens.llm import queries
from fleetlens.llm.ship import ship_code
from llm_cases import ASCII_SPACE


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def slow_repair(conv, rows):
    """By memoised search over whole edit strings, one conversation's rows in order."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(ASCII_SPACE)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))

    def step(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, inserted):
        """The least (cost, letters, rows) from row i in a state; rows as (role, text)."""
        options = []
        if inserted < 3:
            for role in ("user", "assistant"):
                if step(state, role[0]):
                    cost, letters, out = best(i, step(state, role[0]), inserted + 1)
                    options.append((cost + 2, "I" + letters, ((role, ""), *out)))
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
            return min(options) if options else (10**9, "", ())
        _, _, role, text = rows[i]
        cost, letters, out = best(i + 1, state, 0)
        options.append((cost + 3, "D" + letters, out))
        if faults[i] not in ("blank", "duplicate"):
            extra = int(faults[i] == "truncated")
            for letter, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                if step(state, new[:1]):
                    cost, letters, out = best(i + 1, step(state, new[:1]), 0)
                    options.append((cost + price + extra, letter + letters, ((new, text), *out)))
        return min(options)

    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    cost, letters, out = best(0, "", 0) if rows else (0, "", ())
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, digest)


def expected(rows):
    damaged = slow_damage(rows)
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r for r in damaged if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        out.append(slow_repair(conv, mine))
    return sorted(out, key=str)


sys.setrecursionlimit(20_000)
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def messy(seed=5, conversations=150):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "südlich"]
    texts = ["Fine.", "Fine.", "Cut off", "Yes!", "Why? ", "", " ", "\t\n", None, "e。", "é.", "so on…", "a ", "x.\x0b"]
    rows = []
    for c in range(conversations):
        for t in range(rnd.choice([0, 1, 2, 3, 5, 8, 13])):
            turn = rnd.choice([t, t, t, t + rnd.randint(0, 4), None])
            rows.append((c, turn, rnd.choice(roles), rnd.choice(texts)))
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (-4, -2, "assistant", "Late."), (-4, 7, "assistant", "Later.")]
    return rows + rows[:7]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_equals_search_on_messy_rows(spark):
    ship_code(spark)
    rows = messy()
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA + ", conv string, fault string, copies int").repartition(5)
    assert found(cr.repair(cr.damage(df), copies_col="copies")) == expected(rows)


def test_query_equals_search_on_the_given_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF001}/conversations.parquet'").fetchall()
    assert found(queries.op13_conversation_repair(spark, SF001)) == expected(rows)


def test_long_conversations_cross_batches(spark):
    rnd = random.Random(3)
    ship_code(spark)
    rows = [(c, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["One.", "Two", f"{t}.", f"{t}!"])) for c in range(3) for t in range(257 + c)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(cr.repair(cr.damage(spark.createDataFrame(rows, SCHEMA)), copies_col="copies")) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_without_damage_and_a_dropped_conversation(spark):
    ship_code(spark)
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello.")]
    got = found(cr.repair(spark.createDataFrame(rows, SCHEMA)))
    assert [r[:8] for r in got] == [(1, 0, 0, 0, 0, 0, 0, "KKK")]
    dropped = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    got = found(cr.repair(cr.damage(spark.createDataFrame([(9, dropped, "user", "Hi.")], SCHEMA)), copies_col="copies"))
    assert got == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table_and_text_ids(spark):
    ship_code(spark)
    assert found(cr.repair(cr.damage(spark.createDataFrame([], SCHEMA)), copies_col="copies")) == []
    rows = [("a", 0, "user", "Hi."), ("b", 0, "user", "Hi."), ("b", 1, "assistant", "Yes.")]
    got = found(cr.repair(spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string"))))
    assert [(r[0], r[7]) for r in got] == [("a", "KI"), ("b", "KK")]


def test_tables_hold_every_block():
    vectors, blocks = cr.tables()
    assert blocks.shape == (len(vectors), cr.N_SYMBOLS**cr.BLOCK)
    rnd = random.Random(1)
    for _ in range(2000):
        symbols = [rnd.randrange(cr.N_SYMBOLS) for _ in range(cr.BLOCK)]
        v = rnd.randrange(len(vectors))
        costs = vectors[v]
        for s in reversed(symbols):
            costs = cr.before(s, costs)
        least = min(costs)
        assert vectors[blocks[v, cr.block_number(symbols)]] == tuple(c - least for c in costs)
        assert cr.block_symbols(cr.block_number(symbols), cr.BLOCK) == symbols
