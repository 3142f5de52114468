"""Near-equal embeddings by an exact metric range join.

On unit vectors a cosine of ``c`` is a distance of ``sqrt(2 - 2c)``. Pivots part the vectors of a label into
cells of the nearest pivot. A vector within distance r of one in cell j is, by the triangle inequality, at
most 2r farther from pivot j than from its own, so it is copied there, and every cell is joined alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recloom.llm.components import components
from recloom.llm.vectors import matrix, unit, usable
from recloom.llm.staging import stage_rows

COSINE = 0.98
CELL, MAX_PIVOTS = 2_000, 256  # vectors for each pivot, pivots of a label
BLOCK = 4_096  # vectors that a task holds of each side
ROWS = 512
SLACK = 1e-9


def _assign(radius: float):
    """Cells of a chunk of one label's vectors: its home and the cells that it is copied to."""

    def run(vectors: pa.Table, pivots: pa.Table) -> pa.Table:
        n, width = vectors.num_rows, len(vectors.column("embedding")[0]) if vectors.num_rows else 0
        row, cell, home = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        if n:
            x, p = unit(matrix(vectors.column("embedding"), width)), unit(matrix(pivots.column("embedding"), width))
            numbers = pivots.column("pivot").to_numpy().astype(np.int64)
            distance = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
            nearest = distance.argmin(1)
            own = distance[np.arange(n), nearest]
            where = distance <= own[:, None] + 2 * radius + SLACK
            r, c = np.nonzero(where)
            row, cell, home = [r], [numbers[c]], [c == nearest[r]]
        take = pa.array(np.concatenate(row))
        return pa.table(
            {
                "kind": vectors.column("kind").take(take),
                "cell": pa.array(np.concatenate(cell).astype(np.int32), pa.int32()),
                "home": pa.array(np.concatenate(home), pa.bool_()),
                "rep": vectors.column("rep").take(take),
                "copies": vectors.column("copies").take(take),
                "embedding": vectors.column("embedding").take(take),
            }
        )

    return run


def _cell_links(cosine: float):
    """Counts of links of the home vectors of a block, and links that tie what belongs together."""

    def run(table: pa.Table) -> pa.Table:
        width = len(table.column("embedding")[0])
        x = unit(matrix(table.column("embedding"), width))
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        probe = table.column("probe").to_numpy()
        mine, others = np.flatnonzero(probe), np.flatnonzero(~probe)
        nodes, place = np.unique(rep, return_inverse=True)
        group = np.arange(len(nodes))
        links = np.zeros(len(mine), np.int64)
        for a in range(0, len(mine), ROWS):
            rows = mine[a : a + ROWS]
            near = x[rows] @ x[others].T >= cosine
            near &= rep[rows][:, None] != rep[others][None]
            links[a : a + len(rows)] = near @ copies[others]
            for i in np.flatnonzero(near.any(1)).tolist():
                tied = np.unique(group[np.append(place[others[near[i]]], place[rows[i]])])
                if len(tied) > 1:
                    group[np.isin(group, tied)] = tied[0]
        edge = np.flatnonzero(group != np.arange(len(nodes)))
        return pa.table(
            {
                "a": pa.array(np.concatenate((rep[mine], nodes[edge]))),
                "b": pa.array(np.concatenate((rep[mine], nodes[group[edge]]))),
                "links": pa.array(np.concatenate((links, np.zeros(len(edge), np.int64)))),
            }
        )

    return run


def near_equal(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Rows are compared only when their labels are equal and not null. Equal vectors are one class with a count
    of its copies. Vectors that are null, zero or not finite, and rows with a null id, link with nothing; so
    do vectors of different lengths with each other. A row that repeats an id counts as another copy. An
    empty table gives an empty result; other columns are ignored.
    """
    named = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("embedding"),
        F.col(label_col).cast("string").alias("label"),
    )
    sound = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    kind = F.struct("label", F.size("embedding").alias("width"))
    keyed = named.withColumn("kind", F.when(sound, F.to_json(kind)))
    n = vectors.count()
    members = stage_rows(keyed, "vectors", n, 20_000)
    grouped = members.filter("kind is not null").groupBy("kind", "embedding")
    classes = grouped.agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stage_rows(classes, "classes", n, 20_000)

    sizes = classes.groupBy("kind").agg(F.count("*").alias("size"))
    by_hash = Window.partitionBy("kind").orderBy(F.xxhash64("rep"), "rep")
    pivots = classes.withColumn("pivot", F.row_number().over(by_hash)).filter(F.col("pivot") <= MAX_PIVOTS)
    pivots = pivots.join(sizes, "kind").filter(F.col("pivot") <= F.ceil(F.col("size") / CELL))
    part = F.ceil(F.col("size") / BLOCK)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    spread = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n)
    left = classes.join(sizes, "kind").withColumn("part", spread(part, 1)).drop("size")
    right = pivots.withColumn("part", upto(part)).select("kind", "part", "pivot", "embedding")
    right = stage_rows(right, "pivots", -(-n // CELL), 20_000)
    radius = float(np.sqrt(2 - 2 * cosine))
    cells = left.groupBy("kind", "part").cogroup(right.groupBy("kind", "part")).applyInArrow(
        _assign(radius), "kind string, cell int, home boolean, rep long, copies long, embedding array<double>"
    )
    cells = stage_rows(cells, "cells", 2 * n, 20_000)

    # both sides of a cell in blocks
    filled = cells.groupBy("kind", "cell").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / BLOCK).alias("probes"), F.ceil(F.count("*") / BLOCK).alias("blocks")
    ).filter("probes > 0")
    sided = cells.join(filled, ["kind", "cell"])
    columns = ["kind", "cell", "chunk", "block", "probe", "rep", "copies", "embedding"]
    probes = sided.filter("home").withColumns({"probe": F.lit(True), "chunk": spread(F.col("probes"), 2)})
    others = sided.withColumns({"probe": F.lit(False), "block": spread(F.col("blocks"), 3)})
    both = probes.withColumn("block", upto(F.col("blocks"))).select(*columns).unionByName(
        others.withColumn("chunk", upto(F.col("probes"))).select(*columns)
    )
    found = both.groupBy("kind", "cell", "chunk", "block").applyInArrow(
        _cell_links(cosine), "a long, b long, links long"
    )
    found = stage_rows(found, "links", 2 * n)
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    tied = components(found.filter("a <> b").select("a", "b"), n).select(F.col("node").alias("rep"), "component")
    known = classes.join(counts, "rep", "left").join(tied, "rep", "left").select(
        "kind", "embedding", "rep", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    own = members.select("vec_id", "kind", "embedding").join(known, ["kind", "embedding"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return own.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        F.col("vec_id").eqNullSafe(F.when(F.col("vec_id").isNotNull(), component)).alias("kept"),
    )
