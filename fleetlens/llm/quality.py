"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger row stores what was
measured and one bit per failed rule. A policy is a version and a mask of
rules; a document passes it if it fails none of the mask's rules. Policies,
and ablations of single rules, then need only the bits: the corpus is counted
by distinct bit patterns (at most 2 to the number of rules) and no text is
read again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bpe_codec import slices

# ASCII white space and the characters that count as symbols.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOL_BYTES = b"#*$%&|<>"

# Code points of scripts that put no spaces between words (Thai,
# Lao, Tibetan, Myanmar, Khmer, kana, Han, their punctuation and wide forms).
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]+")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unspaced")


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of one text."""
    raw = text.encode()
    words = raw.split()
    seen = Counter(zip(words, words[1:], words[2:]))
    repeated, counted = 0, 0  # words before `counted` were looked at
    if len(seen) < len(words) - 2:
        for k, window in enumerate(zip(words, words[1:], words[2:])):
            if seen[window] > 1:
                repeated += k + 3 - max(k, counted)
                counted = k + 3
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = len(raw) - len(raw.translate(None, SPACE_BYTES))
    symbols = len(raw) - len(raw.translate(None, SYMBOL_BYTES))
    unspaced = 0 if text.isascii() else len(text) - len(UNSPACED.sub("", text))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines), unspaced


@dataclass(frozen=True)
class Rule:
    """A rule's bit is its place in RULES; `fails` is SQL over the measures."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    # A word by white space is a phrase or a line where scripts are written without spaces.
    Rule("long_words", "word_chars > 25 * n_words and 2 * n_unspaced <= word_chars"),
    Rule("symbols", "n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines and n_lines >= 4"),
)


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document under one version."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("v1", (*BASE.rules, "short_words", "long_words", "symbols")),
    Policy("v2", (*BASE.rules, "short_words", "long_words", "symbols", "duplicate_lines")),
)
CURRENT = POLICIES[-1]


def _measured(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The given columns of every row as struct `row`, and the MEASURES of its text."""
    row = F.struct(*[docs[c] for c in columns], docs[text_col].cast("string").alias("text"))
    source = docs.select(row.alias("row"))
    names = [f"c{k}" for k in range(len(columns))]
    kinds = [f.dataType.simpleString() for f in source.schema["row"].dataType.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            whole = batch.column(0)
            found = zip(*[measure(t or "") for t in whole.field(len(names)).to_pylist()])
            kept = {n: whole.field(k) for k, n in enumerate(names)}
            yield pa.RecordBatch.from_pydict(kept | dict(zip(MEASURES, (pa.array(x, pa.int64()) for x in found))))

    schema = [f"{n} {k}" for n, k in zip(names, kinds)] + [f"{m} long" for m in MEASURES]
    measured = source.mapInArrow(run, ", ".join(schema))
    return measured.select(F.struct(*[F.col(n).alias(c) for n, c in zip(names, columns)]).alias("row"), *MEASURES)


def failure_bits() -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id column, the MEASURES and `failed`, the bits of the failed rules.

    Null and empty texts have no words and fail ``few_words``. Texts of any
    length are measured whole. Repeated rows and null ids are kept as they
    come; other columns are not read; an empty table gives no rows.
    """
    rows = _measured(docs, [id_col], text_col)
    return rows.select(f"row.{id_col}", *MEASURES, failure_bits().alias("failed"))


def passes(policy: Policy, failed: Column | None = None) -> Column:
    """Whether a ledger row passes the policy."""
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def judged(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, current: Policy = CURRENT) -> DataFrame:
    """The ledger rows with ``kept_<version>`` of each policy and `sole_rule`, from the bits alone.

    `sole_rule` names the rule that alone rejects the document under `current`:
    without it the document would come back. Else it is null.
    """
    hit = F.col("failed").bitwiseAND(F.lit(current.mask))
    sole = F.lit(None).cast("string")
    for r in current.rules:
        sole = F.when(hit == Policy("", (r,)).mask, r).otherwise(sole)
    return rows.select("*", *[passes(p).alias(f"kept_{p.version}") for p in policies], sole.alias("sole_rule"))


def patterns(rows: DataFrame) -> DataFrame:
    """(failed, n): documents of each distinct bit pattern, all that policies and ablations need."""
    return rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """What each rule does in each policy.

    One row per (version, rule): rejected (documents that fail the rule),
    only_here (those that no other rule of the policy rejects, which would
    come back without it), kept (by the whole policy) and kept_without.
    """
    counted = patterns(rows)
    each = F.explode(
        F.array(*[
            F.struct(F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(Policy("", (r,)).mask).cast("long").alias("bit"))
            for p in policies
            for r in p.rules
        ])
    )
    held = counted.select("failed", "n", each.alias("x")).select("n", "x.version", "x.rule", F.col("failed").bitwiseAND(F.col("x.mask")).alias("hit"), "x.bit")
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    has, alone, none = F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("hit") == F.col("bit"), F.col("hit") == 0
    return held.groupBy("version", "rule").agg(
        some(has).alias("rejected"), some(alone).alias("only_here"), some(none).alias("kept"), some(none | alone).alias("kept_without")
    )


def keep(docs: DataFrame, policy: Policy = CURRENT, *, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass the policy, with all their columns.

    Null and empty texts fail ``few_words`` and go, as every policy holds it.
    Texts of any length are measured whole. Repeated rows and null ids pass or
    fail by their text alone; columns of any name go along; an empty table
    gives no rows.
    """
    rows = _measured(docs, docs.columns, text_col)
    return rows.where(passes(policy, failure_bits())).select("row.*")
