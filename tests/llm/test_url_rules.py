"""URL rules against trying every rule on every URL."""

import random
import re

import pytest
from llm_cases import lower_ascii, ordered, table

from fleetlens.llm import url_rules
from fleetlens.llm.queries import URL_RULES
from fleetlens.llm.ship import ship_code
from fleetlens.llm.url_rules import Rule


def parts(url):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    return (lower_ascii(m[1]), m[2]) if m else ("", "")


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host), len(r.path)), default=None)
    return host, path, best.name if best else None, best.verdict if best else default


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG/", "http://example.org", "https://www.Example.ORG/es/1?x=/y", "http://example.org/en/1", "http://example.org/en/12",
    "http://example.org/en", "http://notexample.org/es/", "http://a.com/fr/#z", "http://a.b.com/de/q", "http://com/de", "http://a.com?/fr/", "x://y://z.org/", "http://é.org/ü",
    "http://org.example.com/de/", "http://a..org/x", "http://.org/", "http://org./x", "http://a.net\n/x", "https://com\x01x/fr/a", "https://x\x01com/fr/a", "https://a.com\x00.com/fr/a", "https://com-x.com/de/", "https://com!/fr/", "http://" + "s." * 3000 + "org/" + "p/" * 3000,
]


def pages(spark, urls):
    ship_code(spark)
    rows = [(i, u, "r", "v") for i, u in enumerate(urls)]
    rows += [(None, urls[-1], None, None), rows[-1]] if urls else []
    return spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string"), rows


def check(spark, urls, rules, **options):
    df, rows = pages(spark, urls)
    got = url_rules.judge(df, rules, **options)
    assert table(got, "page_id", "host", "path", "rule", "verdict") == ordered([(r[0], *brute(r[1], rules)) for r in rows])


def test_the_queries_rules(spark):
    check(spark, URLS, URL_RULES)


def random_rules(n, seed):
    rnd = random.Random(seed)
    host = lambda: ".".join(rnd.choice(["a", "b", "com", "org", "x-y", "a.b"]) for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "/a", "/ab", "b", ""]) for _ in range(rnd.randint(0, 4)))
    rules = list({(h, p): Rule(rnd.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(n))}.values())
    return rules, [f"http://{host()}{path()}" for _ in range(1200)]


def test_nested_random_rules(spark):
    check(spark, *random_rules(300, 5)[::-1])


@pytest.mark.parametrize("start", [1, 3, 256])
def test_many_ranges_give_the_same(spark, monkeypatch, start):
    rules, urls = random_rules(120, 6)
    monkeypatch.setattr(url_rules, "START", start)
    check(spark, URLS + urls, rules, ranges=37)


@pytest.mark.parametrize("start", [1, 2, 256])
def test_ranges_hold_every_row_that_a_rule_may_fit(start):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab/") for _ in range(rnd.randint(0, n)))
    for _ in range(300):
        rows = sorted((word(3), word(5)) for _ in range(rnd.randint(1, 60)))
        cuts = sorted(rnd.sample(range(len(rows)), min(len(rows), 8)) + [0])
        cells = [c for c in (rows[a:b] for a, b in zip(cuts, [*cuts[1:], len(rows)])) if c]
        ends = [[url_rules.place_of(*c[k], start) for c in cells] for k in (0, -1)]
        key, path = word(3), word(3)
        held = {k for k, c in enumerate(cells) for row in c if row[0] == key and row[1].startswith(path)}
        touched = url_rules.ranges_of(*ends, key, path, start)
        assert held <= set(touched)
        if start == 256:  # and none that ends before the rule
            assert all(cells[k][-1] >= (key, path) for k in touched)


def test_copies_of_rules_are_bounded_by_ranges_and_depth(spark):
    ship_code(spark)
    listed = [Rule("block", f"h{i % 50}.com", f"/{i:05}/" + "x/" * (i % 3)) for i in range(20_000)] + [Rule("allow", "com", "/" + "x" * k) for k in range(5)]
    rules = url_rules.rule_rows(spark, listed)
    ends = sorted(url_rules.place_of(f"com/h{i % 50}/", f"/{i:05}/", url_rules.START) for i in range(0, 20_000, 501)) + [("com/h9/", "~")]
    counts = url_rules.deal_rules(rules, list(range(40)), ends[:-1], ends[1:]).groupBy("cell").count().collect()
    # Rules that meet a range's end go to both sides of it: at most the chain of paths there.
    assert sum(r["count"] for r in counts) <= len(listed) + 40 * 5
    assert max(r["count"] for r in counts) < len(listed) / 4


def test_rules_from_a_table(spark):
    rules, urls = random_rules(80, 8)
    given = spark.createDataFrame([(r.verdict, r.host, r.path, "x") for r in rules] + [("block", "a/b", "/", "x"), ("block", None, "/", "x"), ("block", "", None, "x")], "verdict string, host string, path string, key string")
    df, rows = pages(spark, urls)
    assert table(url_rules.judge(df, given), "page_id", "host", "path", "rule", "verdict") == ordered([(r[0], *brute(r[1], rules)) for r in rows])


def test_of_equal_rules_the_first_counts(spark):
    rules = [Rule("block", "a.com", "/x"), Rule("allow", "A.com", "/x"), Rule("allow", "a.com", "/x")]
    got = table(url_rules.judge(pages(spark, ["http://a.com/x"])[0], rules), "rule", "verdict")
    assert got and set(got) == {("a.com/x", "block")}


def test_one_hot_host(spark):
    check(spark, [f"http://www.example.org/en/{i % 30}" for i in range(1500)] + ["http://a.com/de/"], URL_RULES)


def test_no_rows_and_no_rules(spark):
    df, _ = pages(spark, [])
    assert url_rules.judge(df, URL_RULES).count() == 0
    check(spark, URLS, [])


@pytest.mark.parametrize("host", ["a/b", "a?b", "#", ""])
def test_rule_hosts_that_no_url_has_are_refused(spark, host):
    with pytest.raises(ValueError):
        url_rules.rule_rows(spark, [Rule("block", host, "/")])
