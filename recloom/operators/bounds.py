"""Size checks that decide between a broadcast and a shuffled plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

# A broadcast relation is built in the driver and held by every executor.
BROADCAST_ROWS = 200_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows. Reads no more than one row beyond that per task."""
    return df.limit(max_rows + 1).count() <= max_rows
