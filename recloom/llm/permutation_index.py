"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order and posted under each of them. For a query the posting
lists of its own nearest pivots are merged into Spearman footrule distances; the closest permutations are
ranked again by the exact distance of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recloom.llm.vectors import matrix, usable
from recloom.llm.staging import stage_rows

SAMPLE = 2_048  # the bounded sample that the index is fitted on
PIVOTS = 256  # of them, far from each other
NEAREST = 96  # pivots that represent a vector
BLOCK, QUERIES = 16_384, 4_096  # vectors and queries of a task
RERANK = 8  # one of so many vectors of a block, the best by footrule, is measured exactly
NEIGHBOURS, EVERY = 10, 100


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows far from each other, each the farthest from those before: near copies make no second pivot."""
    chosen, far = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def permutations(vectors: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """``vectors`` (.., embedding) with ``order``: the numbers of the nearest pivots, nearest first."""
    place, names, width = vectors.columns.index("embedding"), [*vectors.columns, "order"], pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(_distances(matrix(batch.column(place), width), pivots), axis=1, kind="stable")
            near = np.ascontiguousarray(near[:, :nearest]).astype(np.int16)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * near.shape[1]
            order = pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, order], names)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, ddl + ", order array<smallint>")


def _search(width: int, pivots: int, k: int):
    """The task of one cell: a block of posted vectors and a chunk of queries."""

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and block.num_rows:
            nearest = len(block.column("order")[0])
            posted = matrix(block.column("order"), nearest).astype(np.int64)
            ranks = np.tile(np.arange(nearest), len(posted))
            order = np.argsort(posted.ravel(), kind="stable")
            at = np.searchsorted(posted.ravel()[order], np.arange(pivots + 1))
            who, rank = order // nearest, ranks[order]
            x = matrix(block.column("embedding"), width)
            ids = block.column("ids").to_pylist()
            asked = matrix(queries.column("order"), nearest).astype(np.int64)
            q, q_ids = matrix(queries.column("embedding"), width), queries.column("query_id").to_pylist()
            measured = min(len(x), max(-(-len(x) // RERANK), 4 * k))
            for i in range(len(q)):
                # footrule, up to a constant: every shared pivot takes off what its absence on both sides costs
                saved = np.zeros(len(x), np.int64)
                for mine, pivot in enumerate(asked[i].tolist()):
                    list_ = slice(at[pivot], at[pivot + 1])
                    saved[who[list_]] += 2 * (nearest - np.maximum(rank[list_], mine))
                best = np.argsort(-saved, kind="stable")[:measured]
                exact = np.sqrt(((x[best] - q[i]) ** 2).sum(1))
                found = []
                for j in np.argsort(exact, kind="stable").tolist():
                    if len(found) >= k and exact[j] > found[-1][0]:
                        break
                    found += [(exact[j], v) for v in ids[best[j]] if v != q_ids[i]]
                    found.sort()
                out += [(q_ids[i], v, float(s)) for s, v in found[:k]]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table(
            {n: pa.array(c, t) for n, c, t in zip(["query_id", "vec_id", "score"], columns, kinds, strict=True)}
        )

    return run


def nearest_neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = NEIGHBOURS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` its ``k`` nearest other ids found.

    Equal vectors are indexed once and stand for their smallest ``k + 1`` ids, which is all an answer can hold.
    The pivots are picked from at most 2,048 distinct vectors; all are posted. Vectors that are null, zero, not
    finite, of another length than most or without an id take no part. Ties go to the smaller id; rows that
    repeat id and vector count once. No usable vector gives no row; other columns are ignored.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    named = named.filter(usable("embedding") & F.col("vec_id").isNotNull())
    classes = _classes(named, k + 1)
    spark = vectors.sparkSession
    answer = "query_id long, rank int, vec_id long, score double"
    sample = classes.orderBy(F.xxhash64("embedding"), "least").limit(SAMPLE).select("embedding").collect()
    if not sample:
        return spark.createDataFrame([], answer)
    widths = [len(r["embedding"]) for r in sample]
    width = max(set(widths), key=lambda w: (widths.count(w), -w))
    pivots = spread_pivots(np.array([r["embedding"] for r in sample if len(r["embedding"]) == width], float), PIVOTS)
    nearest = min(NEAREST, len(pivots))

    index = permutations(classes.filter(F.size("embedding") == width), pivots, nearest)
    index = stage_rows(index, "permutations", named.count(), 20_000)
    queries = named.filter((F.col("vec_id") % every == 0) & (F.size("embedding") == width)).distinct()
    queries = queries.withColumnRenamed("vec_id", "query_id")
    queries = stage_rows(permutations(queries, pivots, nearest), "queries", queries.count(), 20_000)
    blocks, chunks = -(-index.count() // BLOCK) or 1, -(-queries.count() // QUERIES) or 1
    spread = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("chunk", spread("query_id", chunks)).withColumn("block", upto(blocks))
    right = index.withColumn("block", spread("least", blocks)).withColumn("chunk", upto(chunks))
    found = (
        left.groupBy("block", "chunk")
        .cogroup(right.groupBy("block", "chunk"))
        .applyInArrow(_search(width, len(pivots), k), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _classes(named: DataFrame, n: int) -> DataFrame:
    """Distinct vectors with their ``n`` smallest ids; a vector that all rows share is cut in the map tasks."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = named.withColumn("place", F.dense_rank().over(first)).filter(F.col("place") <= n)
    return ranked.groupBy("embedding").agg(
        F.array_sort(F.collect_set("vec_id")).alias("ids"), F.min("vec_id").alias("least")
    )
