"""Reading and editing policy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions.scalars import instant


def listing(rules: DataFrame, names: DataFrame, key: str, name: str, subject: str, value: str | None = None) -> DataFrame:
    """Rules with the name of what they forbid, by subject and name. ``value`` narrows to one subject."""
    named = rules.join(names.select(key, F.col(name).alias("name")), key)
    if value is not None:
        named = named.filter(F.col(subject) == value)
    return named.orderBy(subject, "name", key)


def add_rules(current: DataFrame, adds: DataFrame, keys: Sequence[str], at: str, by: str) -> DataFrame:
    """The table after adding rules: known keys are kept as they are, a blank reason fails the job."""
    reason = F.trim("reason")
    checked = F.when(F.coalesce(reason, F.lit("")) == "", F.raise_error(F.lit("a rule needs a reason"))).otherwise(reason)
    new = (
        adds.withColumn("reason", checked)
        .groupBy(*keys)
        .agg(F.min("reason").alias("reason"))
        .join(current.select(*keys), list(keys), "left_anti")
        .withColumn("updated_at", instant(at))
        .withColumn("updated_by", F.lit(by))
    )
    return current.unionByName(new, allowMissingColumns=True)


def remove_rules(current: DataFrame, removals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after removing rules by key."""
    return current.join(removals.select(*keys).distinct(), list(keys), "left_anti")


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """What changed between two versions: ADDED, REMOVED or CHANGED keys with both values."""
    before = old.select(*keys, F.struct(*values).alias("before"), F.lit(True).alias("_old"))
    after = new.select(*keys, F.struct(*values).alias("after"), F.lit(True).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "ADDED")
        .when(F.col("_new").isNull(), "REMOVED")
        .when(~F.col("before").eqNullSafe(F.col("after")), "CHANGED")
    )
    return (
        before.join(after, list(keys), "full_outer")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(
            *keys,
            "change",
            *[F.col(f"before.{v}").alias(f"{v}_before") for v in values],
            *[F.col(f"after.{v}").alias(f"{v}_after") for v in values],
        )
    )


def violations(eligible: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that a rule forbids and that are eligible nevertheless; must be empty."""
    return eligible.filter("is_eligible").join(rules.select(*keys).distinct(), list(keys), "left_semi")
