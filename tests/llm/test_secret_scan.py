"""Base spans against re, statistics against plain Python, discoveries on random strings."""

import base64
import math
import random
import re
import time
from collections import Counter

import pytest
from llm_cases import documents, messy_texts, ordered, table
from pyspark.sql import functions as F

from fleetlens.llm import secret_scan

PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def base_of(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def secrets(seed=11):
    rnd = random.Random(seed)
    key = lambda n: base64.b64encode(rnd.randbytes(n)).decode()
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    access = "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    return [
        f'日本 token = "{hexa(40)}" und PASSWORD: short, Api_Key=\'{key(24)}\'', f"password=secret=token=abcdefgh12", f"{access} AKIASHORT {access}{access}",
        f"{hexa(31)} {hexa(32)}{hexa(32)} x{hexa(64)}", f"token=AKIA{'B' * 20}", "tokentokentoken = = abcdefgh", f"see {key(60)} and {key(45)}",
        "an_ordinary_identifier_of_many_words internationalization/localization/configuration", "a" * 200, "0123456789" * 8,
    ]


def test_base_spans_of_messy_rows(spark):
    docs, rows = documents(spark, messy_texts() + secrets())
    got = secret_scan.scan(docs)
    base = got.select("doc_id", secret_scan.written(F.filter("spans", lambda s: s["base"])).alias("b"))
    want = [(r[0], ",".join(f"{k}:{s}:{e}" for k, s, e in base_of(r[1]))) for r in rows]
    assert table(base, "doc_id", "b") == ordered(want)
    assert sum(bool(w[1]) for w in want) >= 5
    for r in got.collect():  # random spans overlap no base span
        base = [(s.start, s.end) for s in r.spans if s.base]
        assert all(e <= s.start or s.end <= b for s in r.spans if not s.base for b, e in base)
        assert [(s.start, s.kind) for s in r.spans] == sorted((s.start, s.kind) for s in r.spans) or len(r.spans) > 1


def chi_parts(symbols, alphabet):
    n, k = len(symbols), len(alphabet)
    places = [alphabet.index(c) for c in symbols]
    squares = sum(c * c for c in Counter(places).values())
    high = [p >= k / 2 for p in places]
    runs, up = 1 + sum(a != b for a, b in zip(high, high[1:])), sum(high)
    both = 2 * up * (n - up)
    spread = both * (both - n) / (n * n * (n - 1))
    mean = sum(places) / n
    away = [p - mean for p in places]
    power = sum(a * a for a in away)
    lag = sum(a * b for a, b in zip(away, away[1:]))
    chi = k / n * squares - n
    wide = 2 / (9 * (k - 1))
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    return (
        tail(((chi / (k - 1)) ** (1 / 3) - (1 - wide)) / math.sqrt(wide)),
        math.erfc(abs(runs - 1 - both / n) / math.sqrt(spread) / math.sqrt(2)) if spread > 0 else 0.0,
        math.erfc(abs(lag / power + 1 / n) * math.sqrt(n) / math.sqrt(2)) if power > 0 else 0.0,
    )


def test_battery_equals_plain_statistics(spark):
    rnd = random.Random(2)
    found = [base64.b64encode(rnd.randbytes(n)).decode() for n in (15, 30, 60, 200)]
    found += ["".join(rnd.choice("0123456789abcdef") for _ in range(n)) for n in (20, 31)] + ["A" * 25, "ABCD2345" * 4, "international_localisation"]
    rows = spark.createDataFrame([(f,) for f in found], "found string")
    for r in secret_scan.battery(rows).collect():
        symbols = r.found.rstrip("=")
        symbols = symbols.lower() if r.encoding == "hex" else symbols.replace("-", "+").replace("_", "/")
        want = chi_parts(symbols, secret_scan.ALPHABETS[r.encoding][0])
        assert (r.p_uniform, r.p_runs, r.p_serial) == pytest.approx(want, rel=1e-5, abs=1e-9)
        assert r.n == len(symbols) and 0 <= r.p_text <= 1


def test_uniformity_holds_for_random_and_not_for_words(spark):
    rnd = random.Random(6)
    keys = [base64.b64encode(rnd.randbytes(45)).decode() for _ in range(300)]
    syllables = ["inter", "nation", "al", "iza", "tion", "con", "figu", "ra", "lo", "cal", "pre", "ment", "ing", "able"]
    words = ["".join(rnd.choice(syllables) for _ in range(15)) for _ in range(300)]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(keys + words)], "doc_id long, text string")
    found = {r.doc_id for r in secret_scan.scan(docs).collect() if any(s.kind == "random" for s in r.spans)}
    assert sum(i in found for i in range(300)) > 285
    assert sum(i in found for i in range(300, 600)) <= 3


@pytest.mark.parametrize("share", [0.001, 0.01])
def test_power_for_short_keys_among_ordinary_candidates(spark, share):
    rnd = random.Random(12)
    syllables = ["inter", "nation", "al", "iza", "tion", "con", "figu", "ra", "lo", "cal", "pre", "ment", "ing", "able", "Get", "Set", "v2", "2024"]
    ordinary = ["".join(rnd.choice(syllables) + rnd.choice(["", "", "_", "-", "/"]) for _ in range(rnd.randint(8, 14))) for _ in range(8000)]
    symbols = secret_scan.ALPHABETS["base64"][0][:62]
    keys = ["".join(rnd.choice(symbols) for _ in range(n)) for n in (20, 24, 32, 40) for _ in range(int(2000 * share))]
    paths = ["static/content/localization/" + "".join(rnd.choice(symbols) for _ in range(n)) for n in (20, 24, 32, 40)]
    texts = keys + paths + ordinary
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in secret_scan.scan(docs).collect()}
    assert sum(found[i] == [(4, 4 + len(k))] for i, k in enumerate(keys)) >= 0.9 * len(keys)
    for i, t in enumerate(paths, len(keys)):
        assert any(s <= 32 and e == 4 + len(t) for s, e in found[i])
    false = sum(bool(found[i]) for i in range(len(keys) + len(paths), len(texts)))
    assert false <= 0.05 * (len(keys) + len(paths))


def slow_symbols(found):
    symbols = found.rstrip("=")
    name = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", symbols) else "base32" if re.fullmatch("[A-Z2-7]+", symbols) else "base64"
    return name, symbols.lower() if name == "hex" else symbols.replace("-", "+").replace("_", "/")


def slow_scan(texts):
    """The final random spans of each text, by plain loops over all candidates."""
    out, candidates = [], []
    for i, text in enumerate(texts):
        base = [(s, e) for _, s, e in base_of(text)]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text or ""):
            if any(s < m.end() and m.start() < e for s, e in base):
                continue
            parts = [(m.start() + p.start(), p[0], False) for p in re.finditer(r"[A-Za-z0-9+]{20,}={0,2}", m[0]) if p[0] != m[0]] if re.search("[/_-]", m[0]) else []
            candidates += [(i, m.start(), s, f, w) for s, f, w in [(m.start(), m[0], True), *parts]]
    kind = lambda c: "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "+"
    steps = {n: Counter() for n in secret_scan.ALPHABETS}
    shares = {n: Counter() for n in secret_scan.ALPHABETS}
    for *_, f, whole in candidates:
        name, symbols = slow_symbols(f)
        if whole:
            shares[name].update(symbols)
            steps[name].update(zip("^" + "".join(map(kind, symbols)), map(kind, symbols)))
    tested = []
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    for i, run, start, f, whole in candidates:
        name, symbols = slow_symbols(f)
        alphabet, q, cube = secret_scan.ALPHABETS[name]
        n = len(symbols)
        kinds = {kind(c) for c in alphabet}
        log = 0.0
        for a, c in zip("^" + symbols, symbols):
            a = a if a == "^" else kind(a)
            log += math.log((shares[name][c] + 0.5) / sum(shares[name][x] + 0.5 for x in alphabet if kind(x) == kind(c)))
            log += math.log((steps[name][a, kind(c)] + 0.5) / sum(steps[name][a, b] + 0.5 for b in kinds))
        equal = (sum(c * c for c in Counter(symbols).values()) - n) / (n * (n - 1))
        p_text = 1 - tail((equal - q) / math.sqrt(2 / (n * (n - 1)) * (2 * (n - 2) * (cube - q * q) + q - q * q)))
        p = min(1, p_text / 0.9, math.exp(-min(max(-n * math.log(len(alphabet)) - log, 0), 700)) / 0.1)
        uniform, runs, serial = chi_parts(symbols, alphabet)
        product = max(max(uniform, 1e-300) * max(min(1, 2 * min(runs, serial)), 1e-300), 1e-300)
        stratum = name, sum(n >= x for x in secret_scan.LENGTHS)
        step = lambda p: min(math.floor(-math.log10(min(max(p, 1e-300), 1)) * secret_scan.STEPS), secret_scan.LAST_STEP)
        tested.append((stratum, step(p), step(product * (1 - math.log(product))), i, run, start, start + len(f), whole))

    def least(stratum, k, rate):
        p = sorted((10 ** (-t[k] / secret_scan.STEPS), t[k]) for t in tested if t[0] == stratum)
        fine = [s for place, (x, s) in enumerate(p, 1) if x * len(p) <= rate * place]
        return min(fine, default=math.inf)

    limits = {s: (least(s, 1, secret_scan.DISCOVERY_RATE), least(s, 2, secret_scan.REJECTION_RATE)) for s in {t[0] for t in tested}}
    found = [t for t in tested if t[1] >= limits[t[0]][0] and t[2] < limits[t[0]][1]]
    covered = {(t[3], t[4]) for t in found if t[-1]}
    spans = {(t[3], t[5], t[6]) for t in found if t[-1] or (t[3], t[4]) not in covered}
    return [sorted((s, e) for j, s, e in spans if j == i) for i in range(len(texts))]


def test_final_spans_equal_plain_loops(spark):
    rnd = random.Random(21)
    syllables = ["inter", "nation", "al", "iza", "tion", "con", "figu", "ra", "lo", "cal", "Get", "Set", "v2", "2024", "_", "-", "/"]
    symbols = secret_scan.ALPHABETS["base64"][0]
    texts = ["see " + "".join(rnd.choice(syllables) for _ in range(rnd.randint(5, 25))) + " there" for _ in range(600)]
    texts += ["日本 " + "".join(rnd.choice(symbols) for _ in range(rnd.randint(20, 90))) + " x" for _ in range(80)]
    texts += ["static/content/localization/" + "".join(rnd.choice(symbols[:62]) for _ in range(30)) for _ in range(20)]
    texts += ["key=" + "".join(rnd.choice("0123456789ABCDEF") for _ in range(40)) for _ in range(30)] + secrets() + [symbols, "abcdefghijklmnopqrstuvwxyz0123456789" * 3, None, ""]
    want = slow_scan(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted((s.start, s.end) for s in r.spans if s.kind == "random") for r in secret_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(map(bool, want)) > 80


def test_battery_p_value_is_uniform_for_random_strings(spark):
    rnd = random.Random(22)
    symbols = secret_scan.ALPHABETS["base64"][0]
    found = [("".join(rnd.choice(symbols) for _ in range(n)),) for n in (30, 60, 150) for _ in range(700)]
    p = [r.p for r in secret_scan.battery(spark.createDataFrame(found, "found string")).select(secret_scan.p_random().alias("p")).collect()]
    for level in (0.01, 0.05, 0.2):
        assert sum(x <= level for x in p) <= level * len(p) * 1.35 + 3
    assert sum(x <= 0.5 for x in p) > 0.3 * len(p)


def test_discovery_rule_equals_benjamini_hochberg(spark):
    rnd = random.Random(8)
    rows = [(f"s{s}", rnd.choice([0, 5, 20, 40, 60, 100])) for s in range(4) for _ in range(50 * s + 1)]
    got = {r.stratum: r.least_step for r in secret_scan.discovery_steps(spark.createDataFrame(rows, "stratum string, step int"), 0.05).collect()}
    for s in {r[0] for r in rows}:
        p = sorted(10 ** (-k / secret_scan.STEPS) for t, k in rows if t == s)
        fine = [x for i, x in enumerate(p, 1) if x * len(p) <= 0.05 * i]
        assert (10 ** (-got[s] / secret_scan.STEPS) == pytest.approx(max(fine))) if fine else s not in got


def test_empty_table_and_no_python(spark):
    docs = documents(spark, [])[0]
    assert secret_scan.scan(docs).count() == 0
    plan = secret_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_positions_in_blocks_equal_a_plain_fold(spark):
    rnd = random.Random(4)
    edge = secret_scan.BLOCK
    lists = [[rnd.randint(0, 50) for _ in range(n)] for n in (0, 1, edge - 1, edge, edge + 1, edge * edge, edge * edge + 1, 3 * edge * edge + 5)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    sums = secret_scan.before(F.col("x"), lambda a, b: a + b)
    most = secret_scan.before(F.col("x"), lambda a, b: F.greatest(a, b))
    for r in rows.select("i", sums.alias("sums"), most.alias("most")).collect():
        x = lists[r.i]
        want_sums, want_most = [0], [0]
        for v in x:
            want_sums.append(want_sums[-1] + v)
            want_most.append(max(want_most[-1], v))
        assert r.sums == want_sums[:-1] and r.most == want_most[:-1]


def test_runs_clear_of_base_spans_equal_all_comparisons(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        at, runs = 0, []
        for _ in range(rnd.choice([0, 1, 5, 200])):
            at += rnd.randint(0, 12)
            runs.append((at, at + rnd.randint(1, 9), f"r{at}", f"r{at}"))
            at = runs[-1][1]
        named = [(s, s + rnd.randint(1, 15)) for s in sorted(rnd.randint(0, at + 5) for _ in range(rnd.choice([0, 1, 4, 90])))]
        rows.append((i, runs, [(s, 0, e) for s, e in named]))
    span = "array<struct<start:int,end:int,found:string,sized:string>>"
    data = spark.createDataFrame(rows, f"i int, runs {span}, named array<struct<start:int,kind:int,end:int>>")
    for r in data.select("i", secret_scan.clear_of(F.col("runs"), F.col("named")).alias("out")).collect():
        _, runs, named = rows[r.i]
        want = [x for x in runs if not any(s < x[1] and x[0] < e for s, _, e in named)]
        assert [tuple(x) for x in r.out] == want


@pytest.mark.parametrize("kind", ["words", "dump", "run", "assignments"])
def test_cost_of_one_long_text_grows_with_its_length(spark, kind):
    rnd = random.Random(9)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    end = hexa(32)
    text = {
        "words": lambda: "cafe hello " * 900_000,
        "dump": lambda: " ".join(hexa(32) for _ in range(30_000)) + " ",
        "run": lambda: base64.b64encode(rnd.randbytes(300_000)).decode() + " ",
        "assignments": lambda: "token=a " * 200_000,
    }[kind]() + end
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = secret_scan.scan(docs).collect()
    assert time.time() - began < 90  # the square of the matches or symbols takes hours
    base = [(s.kind, s.start, s.end) for s in row.spans if s.base]
    assert base == base_of(text) and base[-1] == ("hex", len(text) - 32, len(text))
