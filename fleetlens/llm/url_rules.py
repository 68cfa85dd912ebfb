"""URL allow and block rules by a sort-merge range join.

A host becomes a key of its labels in reverse, each ended by a slash, which no
host holds. A rule fits a URL if its key is the key of the URL's host or of a
parent of it, and its path begins the URL's path. So each URL asks with (key,
path) for its host and those parents that have as many labels as some rule,
and a rule is the interval of (key, path) from its own to the last path that
begins with its path.

Both sides are sorted by (key, path) and meet in ranges: Spark's range
partitioning divides the questions, and a rule goes to each range that its
interval touches, so rules that are open where a range begins are carried
into it. A task walks one range with a stack of the intervals that hold the
current place. Intervals of one key nest, so the top is the longest path that
fits. The stack is at most as deep as a rule's path is long; no task holds a
list of rules. Each range gets its own rules and as many open ones, so rules
are copied at most (ranges * depth) times more than they are.

Of a URL's answers that of the longest host decides.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.scratch import stored

# A host ends in front of any of these, so none of them is part of a label.
NOT_IN_HOST = "/?#"
END = "/"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters of a key and of a path that tell where a range begins and ends.
#: Where rows differ behind them, a range may get rules that it does not need.
START = 256


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def labels_of(host: Column) -> Column:
    """The labels of a host, the last one first."""
    return F.reverse(F.split(host, r"\.", -1))


def key_of(labels: Column) -> Column:
    """The labels with END after each: hosts with other labels have other keys."""
    return F.concat(F.array_join(labels, END), F.lit(END))


def rule_rows(spark: SparkSession, rules: Iterable[Rule] | DataFrame) -> DataFrame:
    """(key, path, depth, name, verdict) of each (host, path): of equal rules the first, in a DataFrame the least verdict."""
    if isinstance(rules, DataFrame):
        listed = rules.select(F.lit(0).alias("place"), *[rules[c].cast("string").alias(c) for c in ("verdict", "host", "path")])
    else:
        rules = list(rules)
        for r in rules:
            if not r.host:
                raise ValueError("a rule needs a host")
            if any(c in r.host for c in NOT_IN_HOST):
                raise ValueError(f"no URL has a host like {r.host!r}")
        listed = spark.createDataFrame([(k, r.verdict, r.host, r.path) for k, r in enumerate(rules)], "place int, verdict string, host string, path string")
    path = F.coalesce("path", F.lit(""))
    labels = labels_of(lower_ascii(F.col("host")))
    each = listed.where((F.col("host") != "") & ~F.col("host").rlike("[/?#]")).select(
        key_of(labels).alias("key"), path.alias("path"), F.size(labels).alias("depth"), "place", F.concat("host", path).alias("name"), "verdict"
    )
    first = F.min(F.struct("place", "verdict", "name")).alias("first")
    return each.groupBy("key", "path", "depth").agg(first).select("key", "path", "depth", "first.name", "first.verdict")


def place_of(key: str, path: str, start: int) -> tuple[str, str]:
    """A bounded stand-in for (key, path) that keeps the order; what differs behind `start` characters may become equal."""
    return key[:start], path[:start] if len(key) < start else ""


def ranges_of(first: list[tuple[str, str]], last: list[tuple[str, str]], key: str, path: str, start: int) -> range:
    """The ranges that may hold a (key, path) whose path begins with `path`, by the places of the first and last rows of each."""
    key, path = place_of(key, path, start)

    def is_past(at: tuple[str, str]) -> bool:
        return at[0] > key or (at[0] == key and at[1] > path and not at[1].startswith(path))

    begin = bisect.bisect_left(last, (key, path))
    return range(begin, bisect.bisect_left(first, True, lo=begin, key=is_past))


def deal_rules(rules: DataFrame, cells: list[int], first: list[tuple[str, str]], last: list[tuple[str, str]]) -> DataFrame:
    """Each rule once for each range that its interval touches; `cells` names the ranges in order."""
    sent = rules.sparkSession.sparkContext.broadcast((cells, first, last, START))

    def copies(rows: list[tuple[int, int]], batch: pa.RecordBatch) -> pa.RecordBatch:
        names, places = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *batch.take(pa.array(places)).columns], ["cell", *batch.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, *ends, start = sent.value
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row, (key, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                out += [(cells[k], row) for k in ranges_of(*ends, key, path, start)]
                if len(out) >= batch.num_rows:
                    yield copies(out, batch)
                    out = []
            if out:
                yield copies(out, batch)

    return rules.select("key", "path", "name", "verdict").mapInArrow(run, "cell int, key string, path string, name string, verdict string")


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to the questions among rows sorted by (cell, key, path), rules first."""
    at, stack = None, []
    for batch in batches:
        found = []
        for cell, key, path, tag, depth, name, verdict in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (cell, key):
                at, stack = (cell, key), []
            while stack and not path.startswith(stack[-1][0]):
                stack.pop()
            if tag is None:
                stack.append((path, name, verdict))
            elif stack:
                found.append((tag, depth, *stack[-1][1:]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.string(), pa.string()))], ["tag", "depth", "rule", "verdict"])


def judge(
    pages: DataFrame,
    rules: Iterable[Rule] | DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    ranges: int | None = None,
) -> DataFrame:
    """The verdict on every URL.

    Returns one row per row of `pages`: the id column, host, path, rule (host
    and path of the rule that decides, else null) and verdict. A rule fits its
    host and all subdomains if the path begins with the rule's path. The
    longest decides: of fitting hosts the most specific one that has a fitting
    path, and of its paths the longest; where no rule fits, `default`.

    `rules` are Rule objects or a DataFrame with verdict, host and path. Rule
    objects with a host that no URL has are an error; such rows of a DataFrame
    fit nothing, and a null path there is empty. `ranges` is the number of
    ranges, by default that of the shuffle partitions; it changes no result.

    Null URLs and those without :// have an empty host and path, which no rule
    fits. Hosts are compared as bytes after lower-casing A-Z; ports and user
    names are part of the host. Long URLs are compared whole. Repeated rows,
    repeated URLs and null ids are kept as they come; other columns are not
    read; no rows give no rows, and no rules give `default` throughout.
    """
    spark = pages.sparkSession
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("tag"))
    rows = stored(rows, "urls")
    listed = stored(rule_rows(spark, rules), "rules")
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # As many questions a URL as rules have numbers of labels, at most.
    depths = sorted(r.depth for r in listed.select("depth").distinct().collect())
    labels = labels_of(F.col("host"))
    fitting = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda d: d <= F.size(labels))
    asked = rows.select("tag", "path", labels.alias("labels"), F.explode(fitting).alias("depth"))
    asked = asked.select(key_of(F.slice("labels", F.lit(1), F.col("depth"))).alias("key"), "path", "tag", "depth")
    # The tag divides a hot URL too.
    dealt = stored(asked.repartitionByRange(n, "key", "path", "tag").withColumn("cell", F.spark_partition_id()), "questions")
    # One row of bounded size a range.
    place = F.struct(F.substring("key", 1, START), F.when(F.length("key") < START, F.substring("path", 1, START)).otherwise(""))
    spans = dealt.groupBy("cell").agg(F.min(place).alias("first"), F.max(place).alias("last")).orderBy("cell").collect()
    ends = [[tuple(r[name]) for r in spans] for name in ("first", "last")]

    none = lambda kind: F.lit(None).cast(kind)
    questions = dealt.select("cell", "key", "path", "tag", "depth", none("string").alias("name"), none("string").alias("verdict"))
    answers = deal_rules(listed, [r.cell for r in spans], *ends).select("cell", "key", "path", none("long").alias("tag"), none("int").alias("depth"), "name", "verdict")
    sides = questions.unionByName(answers).repartition(n, "cell").sortWithinPartitions("cell", "key", "path", F.col("tag").asc_nulls_first())
    hits = sides.mapInArrow(sweep, "tag long, depth int, rule string, verdict string")
    best = hits.groupBy("tag").agg(F.max_by(F.struct("rule", "verdict"), "depth").alias("best"))
    return rows.join(best, "tag", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
