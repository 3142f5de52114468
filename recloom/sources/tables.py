"""Typed table scans, literal rows and table writes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recloom.schemas import TABLES

# Column defaults of the declared tables.
DEFAULT_TRUE = {
    "region_dim": ["is_active"],
    "game_category_dim": ["is_active"],
    "game_title_dim": ["available_for_play_yn", "is_global_yn", "is_active"],
    "player_dim": ["is_active"],
    "game_round_fact": ["is_round_finished_yn", "is_active"],
}
DEFAULT_FALSE = {
    "game_title_dim": ["has_free_spins_yn", "has_jackpot_yn", "is_progressive_jackpot_yn"],
    "player_dim": ["is_test_player_yn"],
    "game_round_fact": ["is_freespin_yn"],
}


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one table of a warehouse folder with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def values(spark: SparkSession, rows: Iterable[Sequence], ddl: str) -> DataFrame:
    """Hand-written rows inside the plan: the optimizer knows that they are few, so joins to them broadcast."""
    rows = [tuple(row) for row in rows]
    schema = StructType.fromDDL(ddl)
    if not rows:
        return spark.createDataFrame([], schema)
    table = F.array(
        *[
            F.struct(*[F.lit(cell).cast(f.dataType).alias(f.name) for cell, f in zip(row, schema.fields, strict=True)])
            for row in rows
        ]
    )
    return spark.range(1).select(F.inline(table))


def literal_rows(spark: SparkSession, name: str, rows: Iterable[Sequence]) -> DataFrame:
    """Hand-written rows of a declared table (dimensions, policies)."""
    return values(spark, rows, TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project ``df`` onto the declared columns of ``name``: cast, fill absent ones, apply defaults."""
    schema = StructType.fromDDL(TABLES[name])
    truthy, falsy = DEFAULT_TRUE.get(name, []), DEFAULT_FALSE.get(name, [])
    out = []
    for field in schema.fields:
        col = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name not in df.columns and field.name in truthy:
            col = F.lit(True)
        if field.name not in df.columns and field.name in falsy:
            col = F.lit(False)
        out.append(col.cast(field.dataType).alias(field.name))
    return df.select(*out)


# A trace repeats the block list of its market, which may be longer than the window of the default codec.
CODECS = {"recommendation_trace": "zstd"}


def append(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = ()) -> None:
    """Insert-select: add rows to a table."""
    codec = {"compression": CODECS[name]} if name in CODECS else {}
    df.write.mode("append").options(**codec).partitionBy(*partition_by).parquet(f"{root.rstrip('/')}/{name}")


def overwrite(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = ()) -> None:
    """Full reload of a table. ``df`` must not read the same table; see ``versions`` for that."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root.rstrip('/')}/{name}")
