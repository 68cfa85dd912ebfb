"""Corpus pipeline over `documents`: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `documents`, and each works on all rows that its
predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import bpe_codec, curriculum, quality, radix_dedup, simhash
from fleetlens.llm.queries import tokenizer_path
from fleetlens.llm.scratch import stored
from fleetlens.llm.ship import ship_code


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality ledger passes.

    Null and empty texts have too few words and go. Repeated rows and null ids
    pass or fail by their text; an empty table gives no rows.
    """
    ship_code(spark)
    return quality.keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts, that with the largest doc_id.

    Null ids are the smallest; of rows that repeat the largest id any one stays.
    Null texts are empty, and one empty text stays. An empty table gives no rows.
    """
    ship_code(spark)
    return radix_dedup.deduplicate(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Null ids come last, equal ids go by the digest of their texts. Null and
    empty texts have fingerprint zero and form groups like any others. An empty
    table gives no rows.
    """
    ship_code(spark)
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them, up to three times.

    Texts without words, null ones among them, do not come. Null sources are
    one source; repeated rows and null ids each take their own place. An empty
    table gives no rows.
    """
    return curriculum.training_order(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digest and that of the decoded text.

    Null and empty texts have no ids. Repeated rows and null ids are kept as
    they come; an empty table gives no rows.
    """
    ship_code(spark)
    return bpe_codec.encode(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mixing),
    ("bpe_encoding", bpe_encoding),
]

#: SimHash components and BPE merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)
