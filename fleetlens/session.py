"""Spark session settings the reports are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every report relies on. UTC keeps date truncation independent of
# the host; AQE coalesces the small post-aggregation shuffles, splits skewed
# join partitions and turns joins whose measured side is small into
# broadcast-hash joins at runtime.
REPORT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # A join of a large table with the few keys of one period filters the large
    # side by a Bloom filter before its shuffle, whatever the size of the table
    # that the period is cut from. The filter itself holds 8 MB at most.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1p",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    # The latest date of a table can come from file footers (``read_tables``).
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "fleetlens",
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(REPORT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
