"""Secret scans by patterns and by a battery of randomness tests.

Only DataFrame functions. The patterns give the base spans. The method adds
strings that no pattern names: runs of key characters are candidates, each
with the narrowest encoding that holds it (hex, base32, base64), and so are the
pieces of a run between / _ and -. Two questions are asked of a candidate of n
symbols over an alphabet of K.

Is it unlike words and numbers? The chance that two of its symbols are equal
(from the counts that chi-squared uses) is compared with that of ordinary
text, whose letters are uneven; the sampling error shrinks with n, so the
p-value knows the length. Also, the candidate's chance as n random symbols is
divided by that as ordinary candidates of the corpus: a chain of symbol classes
(lower, upper, digit, other) with the symbols' shares in each class, counted
over all runs of the encoding. Under that null the ratio is E or more with
chance 1 / E at most, which is the second p-value. The two are combined by
weighted Bonferroni. Of these p-values, discoveries are those that the
Benjamini-Hochberg rule admits within each stratum (encoding and length class)
over the whole corpus. P-values are rounded up to a grid, so a stratum's rule
needs counts on a grid of fixed size only.

Is it like random symbols? Chi-squared uniformity over the alphabet looks at
how often symbols occur, the runs test about the middle of the alphabet and the
lag-1 serial correlation at their order. Their p-values are combined: the order
tests by Bonferroni, since both see neighbours, and that with chi-squared by
Fisher's sum of logarithms, since under randomness order says nothing about
counts. The Benjamini-Hochberg rule of the candidate's stratum then tells which
candidates are not random, so that of those turned away at most a set share are
random strings, whatever their length.

A discovery is admitted by the first rule and not turned away by the second.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.scratch import stored

# The base patterns, the group whose length counts and its least
# length. Where a match is a whole run of its symbols the pattern asks for the
# length itself: a run too short has no longer match inside it.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A cheap necessary condition of each base pattern, to pass texts without it.
_HINT = {"assign": BASE[0][1], "access": "AKIA", "hex": "[0-9a-f]{32}"}

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
# Alphabets, and for ordinary strings over them the chance that
# two symbols are equal and that three are (letters of running text; digits
# for hex).
ALPHABETS = {
    "hex": ("0123456789abcdef", 0.1, 0.01),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066, 0.0053),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.066, 0.0053),
}
#: What a run is divided into: pieces without / _ and -.
PIECE = r"[A-Za-z0-9+]{20,}={0,2}"
#: Symbol classes, and the steps from the start (^) or a class to a class.
CLASSES = "lud+"
CHAIN = [a + b for a in "^" + CLASSES for b in CLASSES]
#: Part of the error that goes to the likelihood ratio; the rest goes to equal symbols.
RATIO_SHARE = 0.1
#: Lower ends of the length classes.
LENGTHS = (20, 28, 40, 56, 80, 112, 160, 224)
#: Shares of false discoveries: ordinary strings among those admitted, and random
#: ones among those turned away as not random.
DISCOVERY_RATE, REJECTION_RATE = 0.01, 0.001
#: Spans are numbered in blocks of BLOCK, in LEVELS levels of blocks.
BLOCK, LEVELS = 64, 3
#: Grid of p-values: steps per power of ten, and the last step.
STEPS, LAST_STEP = 20, 6000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, join: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each place of an array of whole numbers, `join` over all places before it (0 for none).

    `join` is associative and 0 its neutral element. Appending to an array
    copies it, so values are folded in blocks of BLOCK: the blocks' totals are
    folded first, in blocks too, then each block goes on from what is before it.
    """
    none = F.array().cast("array<int>")

    def block(xs: Column, start: Column) -> Column:
        step = lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(xs, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    if not levels:
        return block(values, F.lit(0))

    def folded(xs: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.ceil(F.size(xs) / BLOCK).cast("int") - 1)
        blocks = F.transform(cuts, lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda parts: F.flatten(F.zip_with(parts, before(F.transform(parts, total), join, levels - 1), block)))

    total = lambda xs: F.aggregate(xs, F.lit(0), join)
    return F.when(F.size(values) <= BLOCK, block(values, F.lit(0))).otherwise(_let(values, folded))


def spans(text: Column, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, found, sized), in code points.

    The text between matches and the matches alternate, so their lengths add
    up to the positions. `sized` is the given group of the match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(found.alias("found"), sized.alias("sized"), F.split(text, pattern, -1).alias("gap"))
    whole = F.filter(parts, lambda x: x["found"].isNotNull())

    def placed(x: Column, at: Column) -> Column:
        begin = at + F.length(x["gap"])
        return F.struct(begin.alias("start"), (begin + F.length(x["found"])).alias("end"), x["found"].alias("found"), x["sized"].alias("sized"))

    sizes = lambda xs: F.transform(xs, lambda x: F.length(x["gap"]) + F.length(x["found"]))
    return _let(whole, lambda xs: F.zip_with(xs, _let(sizes(xs), lambda n: before(n, lambda a, b: a + b)), placed))


def clear_of(runs: Column, named: Column) -> Column:
    """The spans of `runs`, which do not overlap each other, that overlap none of `named`.

    A span overlaps one of them if, of those that begin before its end, the
    furthest end is beyond its start: a running maximum over all in one order.
    """
    kind = "struct<at:int,name:int,other:int,span:struct<start:int,end:int,found:string,sized:string>>"
    ends = F.transform(runs, lambda r: F.struct(r["end"].alias("at"), F.lit(0).alias("name"), r["start"].alias("other"), r.alias("span")).cast(kind))
    begins = F.transform(named, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("name"), b["end"].alias("other"), F.lit(None).alias("span")).cast(kind))

    def kept(events: Column) -> Column:
        reach = F.transform(events, lambda e: F.when(e["name"] == 1, e["other"]).otherwise(0))
        both = F.zip_with(events, _let(reach, lambda r: before(r, lambda a, b: F.greatest(a, b))), lambda e, far: F.struct(e.alias("e"), far.alias("far")))
        return F.transform(F.filter(both, lambda x: (x["e"]["name"] == 0) & (x["far"] <= x["e"]["other"])), lambda x: x["e"]["span"])

    return F.when((F.size(runs) == 0) | (F.size(named) == 0), runs).otherwise(_let(F.array_sort(F.concat(ends, begins)), kept))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,found:string,sized:string>>")


def base_spans(text: Column) -> dict[str, Column]:
    """Array of (start, end, found, sized) of each base kind."""

    def long_enough(least: int):
        return lambda s: F.length(s["sized"]) >= least

    return {
        kind: F.when(text.rlike(_HINT[kind]), F.filter(spans(text, pattern, group), long_enough(least))).otherwise(_none())
        for kind, pattern, group, least in BASE
    }


def erfc(x: Column) -> Column:
    """Complementary error function, to about 1e-7 of its value.

    Fixed values: the Chebyshev coefficients of the usual rational form.
    """
    z = F.abs(x)
    t = 1 / (1 + z / 2)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def normal_tail(z: Column) -> Column:
    """Chance that a standard normal exceeds z."""
    return erfc(z / math.sqrt(2)) / 2


def _encoding(symbols: Column) -> Column:
    narrow = F.when(symbols.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(symbols.rlike("^[A-Z2-7]+$"), "base32")
    return narrow.otherwise("base64")


def _class_of(symbol: str) -> str:
    return "l" if symbol.islower() else "u" if symbol.isupper() else "d" if symbol.isdigit() else "+"


def battery(candidates: DataFrame) -> DataFrame:
    """Test results of each candidate: adds encoding, n, p_text, p_uniform, p_runs, p_serial.

    Also adds what the likelihood ratio needs: counts (of each symbol of the
    alphabet) and chain (of each step in CHAIN).
    `candidates` has a column `found`. A statistic that does not exist (equal
    symbols only) counts as a rejection of randomness.
    """
    out = candidates.withColumn("symbols", F.regexp_replace("found", "=+$", ""))
    out = out.withColumn("encoding", _encoding(F.col("symbols")))
    out = out.withColumn("symbols", F.when(F.col("encoding") == "hex", F.lower("symbols")).otherwise(F.translate("symbols", "-_", "+/")))

    def by_encoding(values: dict[str, object]) -> Column:
        (first, *rest) = values.items()
        chosen = F.when(F.col("encoding") == first[0], F.lit(first[1]))
        for name, v in rest:
            chosen = chosen.when(F.col("encoding") == name, F.lit(v))
        return chosen

    out = out.withColumn("alphabet", by_encoding({k: a for k, (a, _, _) in ALPHABETS.items()}))
    out = out.withColumn("k", F.length("alphabet")).withColumn("n", F.length("symbols"))
    counts = F.transform(
        F.sequence(F.lit(1), F.col("k")),
        lambda i: (F.length("symbols") - F.length(F.replace(F.col("symbols"), F.substr(F.col("alphabet"), i, F.lit(1)), F.lit("")))).cast("double"),
    )
    # The symbols as an array: a place of a string is found by walking there.
    symbols = F.slice(F.split("symbols", ""), F.lit(1), F.col("n"))
    places = F.transform(symbols, lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double"))
    whole = ALPHABETS["base64"][0]
    marked = F.concat(F.lit("^"), F.translate(F.col("symbols"), whole, "".join(map(_class_of, whole))))
    chain = F.array(*[F.regexp_count(marked, F.lit("(?=" + pair.replace("^", r"\^").replace("+", r"\+") + ")")) for pair in CHAIN])
    out = out.withColumns({"counts": counts, "chain": chain})
    out = out.withColumn("squares", F.aggregate("counts", F.lit(0.0), lambda acc, c: acc + c * c)).withColumn("places", places)
    n, k = F.col("n").cast("double"), F.col("k").cast("double")

    # Equal pairs against ordinary text: mean q, variance of the pair count's rate.
    q, cube = (by_encoding({name: v[i] for name, v in ALPHABETS.items()}) for i in (1, 2))
    equal = (F.col("squares") - n) / (n * (n - 1))
    spread = 2 / (n * (n - 1)) * (2 * (n - 2) * (cube - q * q) + q - q * q)
    p_text = 1 - normal_tail((equal - q) / F.sqrt(spread))
    p_text = F.when(equal < q, normal_tail((q - equal) / F.sqrt(spread))).otherwise(p_text)

    # Chi-squared over the alphabet, its tail by the cube root of its ratio to the degrees of freedom.
    chi, free = k / n * F.col("squares") - n, k - 1
    wide = 2 / (9 * free)
    p_uniform = normal_tail((F.cbrt(chi / free) - (1 - wide)) / F.sqrt(wide))

    # Runs above and below the middle of the alphabet.
    high = F.transform("places", lambda v: (v >= F.col("k") / 2).cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v)
    out = out.withColumn("high", high)
    pairs = lambda c: F.arrays_zip(F.slice(c, F.lit(1), F.col("n") - 1).alias("x"), F.slice(c, F.lit(2), F.col("n") - 1).alias("y"))
    up = total(F.col("high"))
    down = n - up
    runs = 1 + total(F.transform(pairs(F.col("high")), lambda p: (p["x"] != p["y"]).cast("double")))
    both = 2 * up * down
    runs_spread = both * (both - n) / (n * n * (n - 1))
    p_runs = F.when(runs_spread > 0, erfc(F.abs(runs - 1 - both / n) / F.sqrt(runs_spread) / math.sqrt(2))).otherwise(0.0)

    # Lag-1 correlation of the symbols' places.
    mean = total(F.col("places")) / n
    out = out.withColumn("away", _let(mean, lambda m: F.transform("places", lambda v: v - m)))
    power = total(F.transform("away", lambda v: v * v))
    lag = total(F.transform(pairs(F.col("away")), lambda p: p["x"] * p["y"]))
    p_serial = F.when(power > 0, erfc(F.abs(lag / power + 1 / n) * F.sqrt(n) / math.sqrt(2))).otherwise(0.0)
    tested = out.withColumns({"p_text": p_text, "p_uniform": p_uniform, "p_runs": p_runs, "p_serial": p_serial})
    return tested.drop("symbols", "alphabet", "k", "squares", "places", "high", "away")


def p_random() -> Column:
    """The battery's p-value under randomness, from a row of `battery`."""
    least = 1e-300
    order = F.greatest(F.least(2 * F.least("p_runs", "p_serial"), F.lit(1.0)), F.lit(least))
    # Twice the negative log of the product of two uniforms is chi-squared with four degrees of freedom.
    product = F.greatest(order * F.greatest("p_uniform", F.lit(least)), F.lit(least))
    return product * (1 - F.ln(product))


def ordinary(tested: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Of each encoding, the log chances of its symbols within their class and of the steps in CHAIN.

    From the sums over all rows of `tested`, a row per encoding; half a count
    is added to each. Keys among the rows only make the null more like them.
    """
    most = max(len(alphabet) for alphabet, _, _ in ALPHABETS.values())
    sums = [F.sum(F.get(name, F.lit(i))).alias(f"{name}_{i}") for name, size in (("counts", most), ("chain", len(CHAIN))) for i in range(size)]
    found = {r.encoding: r for r in tested.groupBy("encoding").agg(*sums).collect()}
    out = {}
    for name, (alphabet, _, _) in ALPHABETS.items():
        def count(column: str) -> float:
            return (found[name][column] or 0) + 0.5 if name in found else 0.5

        symbols = [count(f"counts_{i}") for i in range(len(alphabet))]
        kinds = [_class_of(c) for c in alphabet]
        sizes = {k: sum(n for n, kind in zip(symbols, kinds) if kind == k) for k in kinds}
        steps = [count(f"chain_{i}") if b in sizes else 0.0 for i, (_, b) in enumerate(CHAIN)]
        leaves = {a: sum(n for n, pair in zip(steps, CHAIN) if pair[0] == a) for a in "^" + CLASSES}
        out[name] = (
            [math.log(n / sizes[k]) for n, k in zip(symbols, kinds)],
            [math.log(n / leaves[a]) if n else 0.0 for n, (a, _) in zip(steps, CHAIN)],
        )
    return out


def combined(null: dict[str, tuple[list[float], list[float]]]) -> Column:
    """The p-value that discoveries are made of, from a row of `battery` and the null of `ordinary`."""

    def dot(counts: str, logs: list[float]) -> Column:
        products = F.zip_with(counts, F.array(*map(F.lit, logs)), lambda c, v: c * v)
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    ratio = F.lit(None).cast("double")
    for name, (symbols, steps) in null.items():
        random = -F.col("n") * math.log(len(ALPHABETS[name][0]))
        ratio = F.when(F.col("encoding") == name, random - dot("counts", symbols) - dot("chain", steps)).otherwise(ratio)
    p_ratio = F.exp(-F.least(F.greatest(ratio, F.lit(0.0)), F.lit(700.0)))
    return F.least(F.col("p_text") / (1 - RATIO_SHARE), p_ratio / RATIO_SHARE, F.lit(1.0))


def _stratum() -> Column:
    n = F.col("n")
    place = F.lit(0)
    for k, least in enumerate(LENGTHS):
        place = F.when(n >= least, k).otherwise(place) if k else place
    return F.concat_ws(":", "encoding", place)


def _step(p: Column) -> Column:
    """A p-value's step on the grid, rounded towards larger p."""
    return F.least(F.floor(-F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))) * STEPS), F.lit(LAST_STEP)).cast("int")


def discovery_steps(tested: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """(stratum, least_step): the largest p-value of each stratum that its false-discovery rule admits.

    Of m p-values sorted upwards, the i-th is admitted if some p at or above it
    is at most rate * its place / m. The input is counted on the grid first, so
    a window sees at most LAST_STEP + 1 rows.
    """
    counted = tested.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("c"))
    upwards = Window.partitionBy("stratum").orderBy(F.col("step").desc())
    ranked = counted.select("stratum", "step", F.sum("c").over(upwards).alias("place"), F.sum("c").over(Window.partitionBy("stratum")).alias("m"))
    fine = F.pow(F.lit(10.0), -F.col("step") / STEPS) * F.col("m") <= rate * F.col("place")
    return ranked.where(fine).groupBy("stratum").agg(F.min("step").alias("least_step"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = DISCOVERY_RATE) -> DataFrame:
    """The secrets of every whole text.

    Returns one row per row of `docs`: the id column and `spans`, an array of
    (start, end, kind, base), sorted by start and kind (the base kinds as
    listed, then `random`). Positions are code points, the end exclusive. Base
    spans are all that the patterns give; a `random` span overlaps none. It is a
    whole run, or where that is not admitted a piece of it between / _ and -.

    Null and empty texts have no spans. Texts of any length are scanned whole,
    in time that grows with their length however many matches they hold.
    Repeated rows and null ids are kept as they come; other columns are not
    read; an empty table gives no rows.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"))
    base = base_spans(F.col("text"))

    def of_kind(k: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))

    named = [F.transform(base[kind], of_kind(k)) for k, (kind, *_) in enumerate(BASE)]
    runs = F.when(F.col("text").rlike(CANDIDATE), spans(F.col("text"), CANDIDATE, 0)).otherwise(_none())
    rows = rows.select("id", F.array_sort(F.concat(*named)).alias("base"), runs.alias("runs"))
    apart = clear_of(F.col("runs"), F.col("base"))
    # One pass over the texts; what follows reads spans only.
    rows = stored(rows.select(F.monotonically_increasing_id().alias("tag"), "id", "base", apart.alias("runs")), "secrets")

    each = rows.select("tag", F.explode("runs").alias("r")).select("tag", F.col("r.start").alias("run"), "r.end", "r.found")
    pieces = F.when(F.col("found").rlike("[/_-]"), spans(F.col("found"), PIECE, 0)).otherwise(_none())
    whole = F.struct(F.col("run").alias("start"), "end", "found", F.lit(True).alias("whole"))
    pieces = F.transform(
        F.filter(pieces, lambda s: s["found"] != F.col("found")),
        lambda s: F.struct((F.col("run") + s["start"]).alias("start"), (F.col("run") + s["end"]).alias("end"), s["found"].alias("found"), F.lit(False).alias("whole")),
    )
    each = each.select("tag", "run", F.explode(F.concat(F.array(whole), pieces)).alias("c")).select("tag", "run", "c.*")
    tested = battery(each).withColumn("stratum", _stratum()).withColumn("random_step", _step(p_random()))
    tested = stored(tested.select("tag", "run", "start", "end", "whole", "encoding", "stratum", "n", "p_text", "random_step", "counts", "chain"), "secrets")
    tested = tested.withColumn("step", _step(combined(ordinary(tested.where("whole")))))
    # A row per stratum each: at most 24.
    admitted = discovery_steps(tested.select("stratum", "step"), rate)
    away = discovery_steps(tested.select("stratum", F.col("random_step").alias("step")), REJECTION_RATE).withColumnRenamed("least_step", "away_step")
    judged = tested.join(F.broadcast(admitted), "stratum").join(F.broadcast(away), "stratum", "left")
    found = judged.where((F.col("step") >= F.col("least_step")) & (F.col("away_step").isNull() | (F.col("random_step") < F.col("away_step"))))
    found = found.withColumn("covered", F.max("whole").over(Window.partitionBy("tag", "run"))).where("whole or not covered")
    kind = F.struct("start", F.lit(len(BASE)).alias("kind"), "end")
    per_row = found.groupBy(F.col("tag").alias("_tag")).agg(F.collect_list(kind).alias("more"))
    joined = rows.join(per_row, F.col("tag") == F.col("_tag"), "left")
    whole = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    kinds = F.array(*[F.lit(kind) for kind, *_ in BASE], F.lit("random"))
    return joined.select(
        F.col("id").alias(id_col),
        F.transform(
            whole,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["kind"]).alias("kind"), (s["kind"] < len(BASE)).alias("base")
            ),
        ).alias("spans"),
    )


def written(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
