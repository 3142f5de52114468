"""Ranks that never put a whole table, or a whole hot group, into one task.

A global ``row_number`` is split in two: rows fall into ordered buckets, a tiny table of
bucket counts gives every bucket its starting rank, and the window runs inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recloom.functions import hashing
from recloom.operators.positions import positions

BUCKET_BITS = 16


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based rank.

    ``k`` is a literal, so Spark keeps at most ``k`` rows per group in every map task
    before it shuffles: a hot group never arrives whole.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def bucketed_rank(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    group: Sequence[str] = (),
    quota: int | str | None = None,
    name: str = "rank",
) -> DataFrame:
    """Add the exact 1-based rank of each row by ``order``, per ``group`` or over everything.

    ``order`` must identify a row inside its group. ``bucket`` is a whole number below 2^16
    that never falls as ``order`` rises. With ``quota`` (a number, or SQL over ``group_rows``,
    the size of the group) only the first rows are kept, and buckets wholly beyond it are
    dropped before the shuffle; without ``group`` also before any join below that keeps ``order``.
    """
    placed = df.withColumn("_bucket", bucket)
    where = [*group, "_bucket"]
    counts = placed.groupBy(*where).agg(F.count(F.lit(1)).alias("_rows"))
    # At most 2^16 rows per group from here on.
    along = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"_s_{g}") for g in group],
        F.col("_bucket").alias("_s__bucket"),
        F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_start"),
        F.sum("_rows").over(Window.partitionBy(*group)).alias("group_rows"),
    )
    if quota is not None:
        limit = F.lit(quota) if isinstance(quota, int) else F.expr(quota)
        starts = starts.withColumn("_quota", limit).filter(F.col("_start") < F.col("_quota"))
        if not group:
            last = starts.agg(F.max("_s__bucket")).scalar()
            placed = placed.filter(F.col("_bucket").isNull() | (F.col("_bucket") <= last))
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in where])
    joined = placed.join(starts, match).drop(*[f"_s_{c}" for c in where])
    inside = Window.partitionBy(*where).orderBy(*order)
    ranked = joined.withColumn(name, F.col("_start") + F.row_number().over(inside))
    if quota is not None:
        ranked = ranked.filter(F.col(name) <= F.col("_quota")).drop("_quota")
    return ranked.drop("_bucket", "_start", "group_rows")


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    group: Sequence[str] = (),
    quota: int | str | None = None,
    hasher: hashing.Hasher = hashing.mixed,
    name: str = "hash_rank",
) -> DataFrame:
    """``bucketed_rank`` in hash order: a random but reproducible order of rows identified by ``keys``."""
    hashed = df.withColumn("_hash", hasher([F.col(k) for k in keys], seed))
    bucket = F.shiftright("_hash", 31 - BUCKET_BITS)
    return bucketed_rank(hashed, ["_hash", *keys], bucket, group, quota, name).drop("_hash")


def number_rank(df: DataFrame, key: str, group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Add the exact 1-based rank by a key that is unique inside its group; however its values are spread."""
    placed = positions(df, group, [key], "ranked").withColumn(name, F.col("pos") + 1)
    return placed.select(*[c for c in df.columns if c != name], name)


def hash_sample(
    df: DataFrame, keys: Sequence[str], n: int, seed: int = 42, hasher: hashing.Hasher = hashing.mixed
) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), the same ones on every run."""
    return hash_rank(df, keys, seed, quota=n, hasher=hasher).drop("hash_rank")


def stratified_split(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    test_share: float = 0.2,
    seed: int = 42,
    hasher: hashing.Hasher = hashing.mixed,
) -> DataFrame:
    """Mark ``test_share`` of each label as ``is_test``, exactly and reproducibly."""
    ranked = hash_rank(
        df.withColumn("_stratum", F.col(label)), keys, seed, group=["_stratum"], hasher=hasher, name="_rank"
    )
    sizes = df.groupBy(F.col(label).alias("_size_of")).agg(F.count(F.lit(1)).alias("_size"))
    return (
        ranked.join(sizes, F.col("_stratum").eqNullSafe(F.col("_size_of")))
        .withColumn("is_test", F.col("_rank") <= F.floor(F.col("_size") * F.lit(test_share)))
        .drop("_stratum", "_rank", "_size", "_size_of")
    )


def dense_ids(df: DataFrame, keys: Sequence[str], start: Column, name: str) -> DataFrame:
    """Give rows the consecutive numbers ``start``, ``start + 1``, ... in hash order."""
    return (
        hash_rank(df, keys, seed=0, name="_nth")
        .withColumn(name, (start + F.col("_nth") - 1).cast("bigint"))
        .drop("_nth")
    )


def auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC (Mann-Whitney with average ranks for ties) as a one-row frame.

    Rows collapse to counts per distinct score, which are put in order over range partitions: scores of any
    size and spread will do. ``auc`` is NULL when a class is missing.
    """
    per_score = (
        scored.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
        .groupBy(F.col(score).alias("_s"))
        .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    )
    ranked = positions(per_score, [], ["_s"], "scores", total="_neg")
    wins = F.col("_pos").cast("decimal(19,0)") * (2 * F.col("before") + F.col("_neg")).cast(
        "decimal(19,0)"
    )
    sums = ranked.agg(
        F.sum(wins).alias("_wins"),
        F.coalesce(F.sum("_pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("_neg"), F.lit(0)).alias("negatives"),
    )
    pairs = F.lit(2.0) * F.col("positives").cast("double") * F.col("negatives").cast("double")
    return sums.select(
        (F.col("_wins").cast("double") / F.nullif(pairs, F.lit(0.0))).alias("auc"), "positives", "negatives"
    )
