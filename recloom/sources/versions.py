"""Tables that are rewritten from their own content (policy edits).

Plain Parquet has no MERGE, so every edit writes a whole new version folder and then
publishes it with a small pointer row. Readers follow the newest pointer: a half-written
version is never seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.schemas import TABLES

POINTER = "version BIGINT, folder STRING"


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The published content; fails when the table was never published."""
    base = f"{root.rstrip('/')}/{name}"
    newest = spark.read.schema(POINTER).parquet(f"{base}/pointers").orderBy(F.desc("version"), "folder").first()
    return spark.read.schema(TABLES[name]).parquet(f"{base}/data/{newest['folder']}")


def publish(df: DataFrame, root: str, name: str) -> int:
    """Write ``df`` as the next version and point readers at it; returns the version."""
    spark = df.sparkSession
    base = f"{root.rstrip('/')}/{name}"
    folder = uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{base}/data/{folder}")
    try:
        last = spark.read.schema(POINTER).parquet(f"{base}/pointers").agg(F.max("version")).first()[0] or 0
    except Exception as exc:  # the very first version has no pointer folder yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        last = 0
    pointer = spark.createDataFrame([(last + 1, folder)], POINTER)
    pointer.coalesce(1).write.mode("append").parquet(f"{base}/pointers")
    return last + 1
