"""Places of rows in the order of their group, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recloom.sources.staging import stage


def positions(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "ordered", total: str | None = None
) -> DataFrame:
    """``df`` with ``pos`` (0, 1, ... by ``order`` inside the group) and ``n`` (rows of the group).

    Rows are sorted over range partitions, whose splitters come from a sample of the rows themselves: clustered
    values, outliers and hot groups all lie in partitions of about the same size, as long as ``order`` (nulls
    first) tells rows apart; rows that tie in it come in any order. One row per partition and group gives the
    offsets. With ``total``, a whole-number column, ``before`` is its sum over the earlier rows and ``total_n`` that
    of the group. Without ``groups`` all rows are one group; a null is a group of its own. The sorted rows are
    written to the shared folder, so places stay the same whoever reads them.
    """
    groups = list(groups)
    ordered = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    ordered = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), name)
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    measures = [F.min("_at").alias("_first"), F.count("*").alias("_rows")]
    measures += [F.sum(total).alias("_amount")] if total else []
    runs = ordered.groupBy(*groups, "_part").agg(*measures)
    # a window over at most as many rows as there are partitions
    along = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*groups)
    earlier = lambda c: F.coalesce(F.sum(c).over(along), F.lit(0))
    columns = [(earlier("_rows") - F.col("_first")).alias("_shift"), F.sum("_rows").over(every).alias("n")]
    if total:
        columns += [earlier("_amount").alias("_before"), F.sum("_amount").over(every).alias("total_n")]
    keys = [F.col(c).alias(f"_k_{c}") for c in (*groups, "_part")]
    offsets = stage(runs.select(*keys, *columns), f"{name}-offsets")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in groups], F.col("_part") == F.col("_k__part"))
    placed = ordered.join(offsets, same)
    kept = [*df.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n"]
    if not total:
        return placed.select(*kept)
    inside = Window.partitionBy(*groups, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum(total).over(inside), F.lit(0))
    return placed.select(*kept, before.alias("before"), "total_n")
