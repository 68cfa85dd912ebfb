"""Thin queries over the given tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    arc_to_warc,
    bpe_codec,
    conversation_repair,
    curriculum,
    html_layout,
    phrase_index,
    quality,
    radix_dedup,
    ranked_search,
    secret_scan,
    simhash,
    token_counts,
    url_rules,
)
from fleetlens.llm.scratch import stored
from fleetlens.llm.ship import ship_code


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_code(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(_table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op2_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only what the result needs goes along; the text is compared and hashed.
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = F.sha2(F.encode(radix_dedup.normalised(F.col("text")), "UTF-8"), 256)
    rows = docs.select("doc_id", "text", sha.alias("text_sha256"))
    return radix_dedup.classes(rows).select("row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256")


OP2_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
  sha256(norm) AS text_sha256
FROM t
"""


def op3_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = 512
    counted = token_counts.prefix_counts(_table(spark, sf_dir, "documents"), tokenizer_path(), budget=limit, keep_table=False)
    over = (F.col("n_tokens") > limit).alias("over_limit")
    return counted.select("doc_id", "n_bytes", "n_tokens", over, F.col("chars_in_budget").alias("chars_in_limit"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_to_warc.archive_pages(_table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""


URL_RULES = (
    url_rules.Rule("allow", "org", "/"),
    url_rules.Rule("block", "example.org", "/es/"),
    url_rules.Rule("block", "example.org", "/en/1"),
    url_rules.Rule("allow", "com", "/fr/"),
    url_rules.Rule("block", "com", "/de/"),
)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), URL_RULES)


OP5_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  END AS rule FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stored once: policies and ablations read bits, not texts.
    return stored(quality.ledger(_table(spark, sf_dir, "documents")), "ledger")


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(_ledger(spark, sf_dir))
    versions = [f"kept_{p.version}" for p in quality.POLICIES[1:-1]]
    current = F.col(f"kept_{quality.CURRENT.version}").alias("kept")
    return rows.select("doc_id", *quality.MEASURES, "failed", (~F.col("kept_base")).alias("base_failed"), *versions, current, "sole_rule")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(_ledger(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secret_scan.written(F.filter("spans", lambda s: s["base"]))
    return found.select(
        "doc_id", *[count(kind) for kind, *_ in secret_scan.BASE], F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans")
    )


_LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
windows AS (
  SELECT rid, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS p FROM w)),
again AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
repeated AS (
  SELECT rid, count(DISTINCT p + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (
  SELECT doc_id, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(t) - length(regexp_replace(t, '[\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}]', '', 'g')) AS n_unspaced
  FROM w LEFT JOIN repeated r USING (rid)),
f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (word_chars < 2 * n_words)::BIGINT + 8 * (word_chars > 25 * n_words AND 2 * n_unspaced <= word_chars)::BIGINT
    + 16 * (n_symbols > n_words)::BIGINT + 32 * (2 * n_dup_lines > n_lines AND n_lines >= 4)::BIGINT AS failed
  FROM m)
"""

OP8_SQL = _LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_unspaced, failed,
  failed & 3 <> 0 AS base_failed, failed & 31 = 0 AS kept_v1, failed = 0 AS kept,
  CASE failed WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'short_words'
    WHEN 8 THEN 'long_words' WHEN 16 THEN 'symbols' WHEN 32 THEN 'duplicate_lines' END AS sole_rule
FROM f
"""

ABLATIONS_SQL = _LEDGER_SQL + """
SELECT version, rule, count(*) FILTER (failed & bit <> 0) AS rejected, count(*) FILTER (failed & mask = bit) AS only_here,
  count(*) FILTER (failed & mask = 0) AS kept, count(*) FILTER (failed & (mask - bit) = 0) AS kept_without
FROM f,
  (VALUES ('few_words', 1), ('repeated_words', 2), ('short_words', 4), ('long_words', 8), ('symbols', 16), ('duplicate_lines', 32)) r(rule, bit),
  (VALUES ('base', 3), ('v1', 31), ('v2', 63)) p(version, mask)
WHERE mask & bit <> 0
GROUP BY version, rule
"""


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = curriculum.assign(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda acc, p: acc + p["words"])
    # The passes that take words are the first ones, so the k-th place holds pass k.
    names = ("position", *[f"position_{k}" for k in range(2, curriculum.MOST_PASSES + 1)])
    positions = [F.get("passes", F.lit(k))["position"].alias(name) for k, name in enumerate(names)]
    rows = placed.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"), *positions, "key")
    return stored(rows, "curriculum").orderBy(F.col("position").asc_nulls_last(), "key").drop("key")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS s,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
per AS (SELECT s, sum(size)::BIGINT AS source_size FROM d GROUP BY s),
w AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS weight FROM per),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER lower, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0))::DOUBLE AS level
  FROM w WINDOW lower AS (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, (weight - 2) * 0.5::DOUBLE AS ramp, least(cap::DOUBLE, weight * greatest(max(level) OVER (), 0)) AS target FROM l),
p AS (SELECT *, sum(target) OVER () AS total, sum(ramp * target) OVER () AS bent FROM t),
o AS (
  SELECT d.doc_id, d.size, p.*, coalesce(sum(d.size) OVER (
    PARTITION BY d.s ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN p USING (s)),
k AS (
  SELECT *, list_transform([0, 1, 2], lambda j: least(greatest(floor(target)::BIGINT - (j * source_size + start), 0), size)) AS words,
    list_transform([0, 1, 2], lambda j: (j * source_size + start) / target) AS shares
  FROM o),
x AS (
  SELECT *, list_transform(shares, lambda u: 2 * u / ((1 - ramp) + sqrt(greatest((1 - ramp) * (1 - ramp) + 4 * ramp * u, 0)))) AS moments
  FROM k),
y AS (SELECT *, list_transform(moments, lambda m: total * m + bent * (m * m - m)) AS positions FROM x)
SELECT doc_id, size, source_size, target, list_sum(words)::BIGINT AS taken,
  CASE WHEN words[1] > 0 THEN positions[1] END AS position,
  CASE WHEN words[2] > 0 THEN positions[2] END AS position_2,
  CASE WHEN words[3] > 0 THEN positions[3] END AS position_3
FROM y
"""


def op10_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_layout.extract(_table(spark, sf_dir, "pages"))
    return text.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    items = F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256)
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[s:s + 9] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
grams AS (
  SELECT rid, s, n, w[s:s + n - 1] AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s
    FROM d JOIN (SELECT DISTINCT len(g) AS n FROM win) ON len(w) >= n)),
m AS (SELECT rid, s, n, item_id FROM grams JOIN win USING (g)),
hit AS (
  SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM m)) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, coalesce(item_id::VARCHAR, '') AS item FROM m) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)
"""


def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
s AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS total FROM d),
i AS (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS words FROM benchmark),
q AS (SELECT item, item_id, t, count(*) AS r FROM (SELECT item, item_id, unnest(words) AS t FROM i) GROUP BY ALL),
f AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(words) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM f GROUP BY t), s),
m AS (SELECT rid, doc_id, 100 - 25 + (25 * len(words) * n_docs) // total AS m FROM d, s WHERE len(words) > 0),
score AS (
  SELECT item, item_id, rid, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (rid) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged, copies_col="copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_bpe_codec,
        op2_radix_dedup,
        op3_prefix_token_counts,
        op4_arc_to_warc,
        op5_url_rules,
        op6_simhash_near_dedup,
        op7_secret_scan,
        op8_quality_ledger,
        op9_curriculum_mix,
        op10_html_layout,
        op11_phrase_index,
        op12_bag_search,
        op13_conversation_repair,
        quality_ablations,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""
    return {
        "op2_radix_dedup": OP2_SQL,
        "op4_arc_to_warc": OP4_SQL,
        "op5_url_rules": OP5_SQL,
        "op8_quality_ledger": OP8_SQL,
        "quality_ablations": ABLATIONS_SQL,
        "op9_curriculum_mix": OP9_SQL,
        "op11_phrase_index": OP11_SQL,
        "op12_bag_search": OP12_SQL,
    }
