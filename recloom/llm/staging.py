"""Intermediate tables with few files where a bound on their rows is known."""

from __future__ import annotations

from pyspark.sql import DataFrame

from recloom.sources.staging import stage

ROWS_PER_FILE = 200_000


def stage_rows(df: DataFrame, name: str, rows: int, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write ``df``, of at most about ``rows`` rows, in as many files as they need, not one per shuffle partition."""
    return stage(df.repartition(max(1, -(-rows // per_file))), name)
