"""Data checks as frames: an empty result, or a true flag, means healthy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def uniqueness(df: DataFrame, column: str) -> DataFrame:
    """Row count against distinct count of one column.

    Values are counted per value first, so a frequent value is merged before the shuffle.
    """
    per_value = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(column).alias("distinct_values")
    ).withColumn("is_unique", F.col("rows") == F.col("distinct_values"))
