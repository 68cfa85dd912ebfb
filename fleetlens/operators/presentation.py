"""Final ordering of a report's rows.

Every report keeps the reference's ORDER BY. How it is sorted depends on
what bounds the result:

* results with one row per calendar period or season are bounded by the
  calendar; they are moved to one partition and sorted there (``bounded``),
  which avoids the sampling job a range partitioning needs;
* results with one row per driver, truck, customer or route (or a
  tie-dependent top-k) grow with the data and get a distributed range sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def present(df: DataFrame, *order: Column | str, bounded: bool = False) -> DataFrame:
    if bounded:
        return df.repartition(1).sortWithinPartitions(*order)
    return df.orderBy(*order)
