"""Row keys for reproducible sampling and random picks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hash values are 31-bit so that products of two of them stay inside a signed long.
SPACE = 2_147_483_647

Hasher = Callable[[Sequence[Column], int], Column]


def mixed(cols: Sequence[Column], seed: int) -> Column:
    """Default hasher: xxhash64 folded to 0..SPACE-1."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(SPACE))


def portable(cols: Sequence[Column], seed: int) -> Column:
    """A hasher of whole-number columns that any SQL engine can repeat with * + %."""
    value = F.lit(seed).cast("bigint")
    for col in cols:
        value = (value * 1_000_003 + F.pmod(col.cast("bigint"), F.lit(SPACE)) * 69_621 + 12_345) % SPACE
    return (value * 48_271 + 11) % SPACE


def portable_sql(cols: Sequence[str], seed: int) -> str:
    """``portable`` as SQL text."""
    value = f"CAST({seed} AS BIGINT)"
    for col in cols:
        value = f"(({value} * 1000003 + (CAST({col} AS BIGINT) % {SPACE}) * 69621 + 12345) % {SPACE})"
    return f"(({value} * 48271 + 11) % {SPACE})"
