"""Weighted sampling: a pool expanded by weight, and picks from it by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions import hashing
from recloom.operators.joins import weighted_rows
from recloom.operators.ranking import hash_rank


def weighted_pool(
    items: DataFrame, weights: DataFrame, segment: str, seed: int = 42, hasher: hashing.Hasher = hashing.mixed
) -> DataFrame:
    """Each item of a category ``weight`` times per segment, shuffled, at positions 0..n-1."""
    copies = weighted_rows(items.select("game_title_id", "category_id").join(weights, "category_id"), "weight")
    ranked = hash_rank(copies, ["game_title_id", "copy"], seed, group=[segment], hasher=hasher, name="nth")
    return ranked.select(segment, "game_title_id", (F.col("nth") - 1).alias("position"))


def pool_sizes(pool: DataFrame, segment: str) -> DataFrame:
    return pool.groupBy(segment).agg(F.count(F.lit(1)).alias("pool_size"))


def weighted_pick(
    rows: DataFrame,
    pool: DataFrame,
    segment: str,
    keys: list[str],
    seed: int = 42,
    hasher: hashing.Hasher = hashing.mixed,
) -> DataFrame:
    """Give every row an item of its segment's pool, with probability proportional to weight."""
    position = hasher([F.col(k) for k in keys], seed) % F.col("pool_size")
    return (
        rows.join(pool_sizes(pool, segment), segment)
        .withColumn("position", position)
        .join(pool, [segment, "position"])
        .drop("pool_size", "position")
    )
