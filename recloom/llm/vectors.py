"""Embedding rows that can be compared, and cells of Arrow rows as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """Not null, not empty, not zero, and every component a finite number."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(col).isNotNull() & finite & F.exists(col, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy().astype(np.float64).reshape(-1, width)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very small and large components."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))
