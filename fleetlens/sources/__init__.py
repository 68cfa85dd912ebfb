"""Logical tables: declared schemas, readers, writers and the fixture adapter."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fleetlens.sources.fixtures import derive_tables
from fleetlens.sources.schema import SCHEMAS, TABLE_NAMES, conform


@dataclass(frozen=True)
class Tables:
    """The eight logical tables a report may read (lazy DataFrames).

    ``trips_by_load`` is a second copy of the trips, laid out for joins on
    ``load_id``; ``dates`` holds readings of a table that serve for its latest
    date only. Both are optional: ``for_loads`` and ``dated`` fall back to the
    tables themselves.
    """

    trips: DataFrame
    delivery_events: DataFrame
    loads: DataFrame
    fuel_purchases: DataFrame
    maintenance_records: DataFrame
    trucks: DataFrame
    customers: DataFrame
    safety_incidents: DataFrame
    trips_by_load: DataFrame | None = None
    dates: dict[str, DataFrame] | None = None

    @classmethod
    def from_dict(cls, frames: dict[str, DataFrame]) -> "Tables":
        return cls(**{name: conform(frames[name], name) for name in TABLE_NAMES})

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_NAMES}

    def for_loads(self) -> DataFrame:
        """The trips in the layout that suits a join on ``load_id``."""
        return self.trips if self.trips_by_load is None else self.trips_by_load

    def dated(self, name: str) -> DataFrame:
        """Table ``name`` as its latest date is best read from."""
        return (self.dates or {}).get(name, getattr(self, name))

    def register_views(self) -> None:
        """Expose the tables as session temp views under their logical names.

        Lets users also query them with ``spark.sql`` under the table names
        the reports use (``trips``, ``loads``, ...).
        """
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(name)


def load_fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Logical tables derived on the fly from a fixture folder (TPC-H-like parquet)."""
    return Tables(**derive_tables(spark, sf_dir))


def read_tables(spark: SparkSession, path: str, *, dates_from_statistics: bool = False) -> Tables:
    """Read stored logical tables ``<path>/<table>`` with their declared schemas.

    The schema is given to the reader, so no inference pass runs and only the
    columns a report selects are read from the files. Tables stored
    partitioned by their date column (``write_tables(partition_by_date=True)``)
    read the same way: the declared schema names the partition column and
    fixes its type.

    ``dates_from_statistics=True`` takes the latest date of each dated table
    from the statistics in the file footers, so that no row is read for it.
    Every row group must then hold a date (files may be empty, tables may be,
    and single dates may be null): Spark refuses to answer for a row group
    whose dates are all null.
    """
    base = path.rstrip("/")
    frames = {name: conform(spark.read.schema(SCHEMAS[name]).parquet(f"{base}/{name}"), name) for name in TABLE_NAMES}
    dates = None
    if dates_from_statistics:
        with _aggregating_reader(spark):
            dates = {name: spark.read.schema(SCHEMAS[name]).parquet(f"{base}/{name}").select(col) for name, col in DATE_COLUMNS.items()}
    return Tables(**frames, dates=dates)


@contextmanager
def _aggregating_reader(spark: SparkSession):
    """Parquet readings begun inside go through the reader that can answer a max from footers."""
    key = "spark.sql.sources.useV1SourceList"
    old = spark.conf.get(key)
    spark.conf.set(key, ",".join(name for name in old.split(",") if name.strip() != "parquet"))
    try:
        yield
    finally:
        spark.conf.set(key, old)


# The date column of each fact table, used as its partition column when the
# tables are stored partitioned by date.
DATE_COLUMNS = {
    "trips": "dispatch_date",
    "delivery_events": "actual_date",
    "loads": "load_date",
    "maintenance_records": "maintenance_date",
    "safety_incidents": "incident_date",
}


def write_tables(
    tables: Tables,
    path: str,
    mode: str = "overwrite",
    *,
    partition_by_date: bool = False,
    files: int | None = None,
) -> None:
    """Store the logical tables as parquet under ``path`` (one folder per table).

    Used to materialise the fixture-derived tables once, so reports read
    stored tables as they would in production instead of re-deriving them.

    ``partition_by_date=True`` stores each dated fact table in one folder per
    day of its date column. The latest-period and trailing-window filters of
    the reports are range predicates on that column, so Spark prunes whole
    folders at run time (the scalar subquery is evaluated first). At fixture
    sizes the many small folders cost more in listing than they save.

    ``files=n`` writes each table as about ``n`` files so later scans get that
    many tasks. Dated fact tables are range-partitioned and sorted by their
    date: each file then covers a narrow date range, so the latest-period
    filters skip whole files and row groups on their min/max statistics.
    """
    base = path.rstrip("/")
    for name, df in tables.as_dict().items():
        date_col = DATE_COLUMNS.get(name)
        if partition_by_date and date_col:
            # One shuffle by day so each folder gets few, large files.
            df.repartition(date_col).write.mode(mode).partitionBy(date_col).parquet(f"{base}/{name}")
            continue
        if files and date_col:
            df = df.repartitionByRange(files, date_col).sortWithinPartitions(date_col)
        elif files:
            df = df.repartition(files)
        df.write.mode(mode).parquet(f"{base}/{name}")


# Bucket column of the tables that are joined on trip ids or load ids. Bucketing
# them alike (same column, same bucket count) lets these joins and the
# pre-aggregates on the same key run without a shuffle. Trips join on both, so
# they are stored in both layouts.
BUCKET_KEYS = {
    "trips": "trip_id",
    "fuel_purchases": "trip_id",
    "delivery_events": "trip_id",
    "loads": "load_id",
    "trips_by_load": "load_id",
}


def save_bucketed_tables(
    tables: Tables, database: str, buckets: int, location: str | None = None
) -> None:
    """Save the logical tables as catalog tables, the facts bucketed by their join key.

    Bucketing needs a catalog: the tables are written with ``saveAsTable`` into
    ``database`` (created at ``location`` if given). ``trips``,
    ``fuel_purchases`` and ``delivery_events`` are bucketed and sorted by
    ``trip_id``, ``loads`` and a second copy of the trips (``trips_by_load``)
    by ``load_id``, all into ``buckets`` buckets; the others are plain tables.
    """
    spark = tables.trips.sparkSession
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
    for name, df in {**tables.as_dict(), "trips_by_load": tables.trips}.items():
        writer = df.write.mode("overwrite").format("parquet")
        if name in BUCKET_KEYS:
            # One shuffle by the key first, so that each bucket is one file and its sort order holds.
            key = BUCKET_KEYS[name]
            writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")


def read_catalog_tables(spark: SparkSession, database: str) -> Tables:
    """The logical tables from catalog tables ``<database>.<table>`` (bucketing kept).

    A database without the second layout of the trips serves as well.
    """
    frames = {name: conform(spark.table(f"{database}.{name}"), name) for name in TABLE_NAMES}
    second = f"{database}.trips_by_load"
    by_load = conform(spark.table(second), "trips") if spark.catalog.tableExists(second) else None
    return Tables(**frames, trips_by_load=by_load)


__all__ = [
    "BUCKET_KEYS",
    "DATE_COLUMNS",
    "SCHEMAS",
    "TABLE_NAMES",
    "Tables",
    "conform",
    "load_fixture_tables",
    "read_catalog_tables",
    "read_tables",
    "save_bucketed_tables",
    "write_tables",
]
