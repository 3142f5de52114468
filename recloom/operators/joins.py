"""Join shapes of the recommendation plans.

No strategy is forced here: AQE broadcasts a side when its measured size is small and splits
skewed partitions of shuffled joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exists_flag(df: DataFrame, rules: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Left join as a yes/no column; repeated rules do not repeat rows."""
    marked = rules.select(*keys).dropDuplicates().withColumn(name, F.lit(True))
    return df.join(marked, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def lookup(df: DataFrame, side: DataFrame, key: str, columns: Mapping[str, Column | None]) -> DataFrame:
    """Attach columns of the row with the same ``key``; a given default replaces NULL."""
    picked = side.select(key, *columns)
    out = df.join(picked, key, "left")
    return out.withColumns({c: F.coalesce(c, d) for c, d in columns.items() if d is not None})


def weighted_rows(df: DataFrame, weight: str) -> DataFrame:
    """Each row ``weight`` times, as ``copy`` 0..weight-1; rows of weight 0 disappear."""
    return df.filter(F.col(weight) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(weight) - 1)))


def feature_group(views: Sequence[DataFrame], key: str) -> DataFrame:
    """Bundle feature views on one key, without prefixes; the first view sets the rows.

    Raises when two views share a feature name.
    """
    seen: set[str] = set()
    for view in views:
        names = set(view.columns) - {key}
        if seen & names:
            raise ValueError(f"feature names collide: {sorted(seen & names)}")
        seen |= names
    out = views[0]
    for view in views[1:]:
        out = out.join(view, key, "left")
    return out


def to_add(current: DataFrame, offered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Offered rows that are not there yet."""
    return offered.join(current.select(*keys).distinct(), list(keys), "left_anti")


def only_selected(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys were chosen."""
    return df.join(chosen.select(*keys).distinct(), list(keys), "left_semi")
