"""Connected components by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.llm.staging import stage_rows


def _towards(edges: DataFrame) -> DataFrame:
    """Join each node's smallest neighbour to its edges: columns u, v, m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return edges.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(links: DataFrame, rows: int) -> DataFrame:
    """``links`` (a, b) as (node, component): the smallest node reachable. Nodes without links are absent.

    ``rows`` is a bound on the links, or a guess; it only sets the number of files of the first round. Nulls and self-links are ignored; repeated links count once; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stage_rows(edges.filter("u <> v").distinct(), "links", rows)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = _towards(large.filter("u <> v").distinct())
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = down.select(F.explode(ends).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = stage_rows(small, "stars", before[0])
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
