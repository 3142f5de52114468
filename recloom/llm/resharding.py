"""Resharding by minimum-cost flow: new capacities are met by moving as few bytes as possible.

The flow runs from the old shards' sizes to the new capacities. A byte that stays costs nothing, one that moves
costs 1, more between zones. Of each old shard the flow names the blocks (byte ranges of its rows, largest row
first) that go to other shards; rows follow their block, and only the files of shards that lose rows are rewritten.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recloom.operators.positions import positions
from recloom.sources.staging import stage

OLD_SHARDS, NEW_SHARDS, ROUNDS = 12, 16, 2
SMALL_LAST, MIXED = ("less", "text_crc32", "doc_id"), ("text_crc32", "doc_id")


@dataclass(frozen=True)
class Block:
    """Bytes ``low`` to ``high`` of an old shard, which belong into a new one."""

    old: int
    new: int
    low: int
    high: int


class Network:
    """A flow network; ``solve`` sends as much as possible along ever dearer shortest paths."""

    def __init__(self):
        self.out: dict[object, list[int]] = {}
        self.head, self.room, self.cost = [], [], []

    def arc(self, tail, head, room: int, cost: int = 0) -> int:
        """Add an arc and its reverse; returns its number."""
        for a, b, r, c in ((tail, head, room, cost), (head, tail, 0, -cost)):
            self.out.setdefault(a, []).append(len(self.head))
            self.out.setdefault(b, [])
            self.head.append(b)
            self.room.append(r)
            self.cost.append(c)
        return len(self.head) - 2

    def sent(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def solve(self, source, sink) -> None:
        while True:
            far, came, waiting = {source: 0}, {}, deque([source])
            queued = {source}
            while waiting:
                node = waiting.popleft()
                queued.discard(node)
                for k in self.out.get(node, ()):
                    then = far[node] + self.cost[k]
                    if self.room[k] and then < far.get(self.head[k], then + 1):
                        far[self.head[k]], came[self.head[k]] = then, k
                        if self.head[k] not in queued:
                            queued.add(self.head[k])
                            waiting.append(self.head[k])
            if sink not in came:
                return
            path, node = [], sink
            while node != source:
                path.append(came[node])
                node = self.head[came[node] ^ 1]
            amount = min(self.room[k] for k in path)
            for k in path:
                self.room[k] -= amount
                self.room[k ^ 1] += amount


def transfers(
    sizes: Mapping[int, int],
    capacities: Sequence[int],
    zone: Callable[[int], int] = lambda shard: 0,
    far: int = 2,
) -> list[Block]:
    """The blocks of every old shard, cheapest in all: old shard ``i`` and new shard ``i`` are the same place.

    ``sizes`` are bytes by old shard, ``capacities`` bytes by new shard, enough for all. A byte that moves costs 1
    inside its zone and ``far`` beyond. Works on shard sizes alone, with arcs in proportion to shards and pairs of
    zones; what stays comes first in its shard, then the moves by the number of the new shard.
    """
    if sum(sizes.values()) > sum(capacities):
        raise ValueError("the capacities are too small")
    net, old, new = Network(), sorted(sizes), range(len(capacities))
    stay, leave, come, cross = {}, {}, {}, {}
    for i in old:
        net.arc("from", ("old", i), sizes[i])
        if i in new:
            stay[i] = net.arc(("old", i), ("new", i), sizes[i])
        leave[i] = net.arc(("old", i), ("out", zone(i)), sizes[i], 1)
    for a in sorted({zone(i) for i in old}):
        for b in sorted({zone(j) for j in new}):
            cross[a, b] = net.arc(("out", a), ("in", b), sum(sizes.values()), 0 if a == b else far - 1)
    for j in new:
        come[j] = net.arc(("in", zone(j)), ("new", j), capacities[j])
        net.arc(("new", j), "to", capacities[j])
    net.solve("from", "to")

    gives, takes = {i: net.sent(k) for i, k in leave.items()}, {j: net.sent(k) for j, k in come.items()}
    moved: dict[tuple[int, int], int] = {}
    for (a, b), k in cross.items():
        amount = net.sent(k)
        givers, takers = (x for x in old if zone(x) == a), [x for x in new if zone(x) == b]
        for i in givers:
            for j in takers:
                some = min(amount, gives[i], takes[j])
                if some:
                    moved[i, j] = moved.get((i, j), 0) + some
                    amount, gives[i], takes[j] = amount - some, gives[i] - some, takes[j] - some
    blocks = []
    for i in old:
        parts = [(i, net.sent(stay[i]) if i in stay else 0), *((j, moved.get((i, j), 0)) for j in new if j != i)]
        low = 0
        for j, amount in parts:
            # a shard moved to itself through its zone is a stay; the flow never pays for that
            if amount:
                blocks.append(Block(i, j, low, low + amount))
                low += amount
    return blocks


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def place(
    rows: DataFrame, capacities: Callable[[int], Sequence[int]], order: Sequence[str] = SMALL_LAST, **costs
) -> DataFrame:
    """``rows`` (shard, size, less, ...) with ``new_shard`` and ``slot`` (gapless from 0 in the new shard).

    Rows of a shard are laid out by ``order``; a row goes where its middle byte lies. By ``SMALL_LAST`` (``less`` is
    minus the size) the ends of blocks fall on small rows; by ``MIXED`` every block has rows of all sizes. In both,
    equal texts lie together.
    """
    laid = positions(rows, ["shard"], [*order], "shard-rows", total="size")
    # one row per old shard
    sizes = {r["shard"]: r["size"] for r in rows.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    blocks = transfers(sizes, capacities(sum(sizes.values())), **costs)
    listed = [(b.old, b.new, 2 * b.low, 2 * b.high) for b in blocks]
    table = rows.sparkSession.createDataFrame(listed, "shard int, new_shard int, low long, high long")
    # the table of blocks grows with the shards alone, not with the rows
    middle = 2 * F.col("before") + F.col("size")
    found = laid.join(F.broadcast(table), "shard").filter((middle >= F.col("low")) & (middle < F.col("high")))
    found = stage(found.drop("low", "high", "before", "total_n", "n"), "shard-places")
    runs = found.groupBy("new_shard", "shard").agg(F.count("*").alias("rows"), F.min("pos").alias("first"))
    along = Window.partitionBy("new_shard").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(along), F.lit(0)) - F.col("first")
    shifts = runs.select("new_shard", "shard", shift.alias("shift"))
    out = found.join(shifts, ["new_shard", "shard"])
    return out.withColumn("slot", F.col("pos") + F.col("shift")).drop("pos", "shift")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """doc_id, size (bytes of the text, plus 1), less (minus that) and text_crc32; a null text is empty."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = F.octet_length(data).cast("long") + 1
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        (-size).alias("less"),
        F.crc32(data).alias("text_crc32"),
    ]


def reshard(
    docs: DataFrame, old_shards: int = OLD_SHARDS, shards: int = NEW_SHARDS, rounds: int = ROUNDS, **costs
) -> DataFrame:
    """All ``docs`` in shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard.

    The old shard of a row is the crc32 of its text modulo ``old_shards``. The first round meets the capacities up
    to the rows at the ends of blocks; the last one, from where that left the rows, evens it out with the smallest
    rows of each shard. A null text is empty; rows with null ids or that repeat are rows of their own. A group of equal
    texts stays together unless the end of a block falls into it, as one may be larger than a shard. A row larger
    than its shard's share makes that shard larger. Other columns are ignored; an empty table gives an empty result.
    """
    old = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")) % old_shards
    rows = docs.select(*measured(docs), old.cast("int").alias("shard")).withColumn("old_shard", F.col("shard"))
    rows = stage(rows, "sizes")
    for k in range(rounds):
        order = SMALL_LAST if k + 1 == rounds else MIXED
        rows = place(rows, lambda total: even(total, shards), order, **costs)
        if k + 1 < rounds:
            rows = stage(rows.drop("slot").drop("shard").withColumnRenamed("new_shard", "shard"), "shards")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("new_shard").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def read_layout(spark: SparkSession, layout: Mapping[int, Sequence[str]]) -> DataFrame:
    """All rows of a layout (folders by shard), with ``shard`` as a last column."""
    folders = sorted({f for parts in layout.values() for f in parts})
    shard = F.regexp_extract("_metadata.file_path", r"/shard=([0-9]+)/[^/]*$", 1).cast("int")
    return spark.read.parquet(*folders).withColumn("shard", shard)


def write_layout(rows: DataFrame, root: str) -> dict[int, list[str]]:
    """Write rows with a column ``shard`` into one folder per shard under ``root``; returns the folders by shard."""
    present = sorted(r["shard"] for r in rows.select("shard").distinct().collect())  # one row per shard
    rows.repartitionByRange("shard", "doc_id").write.partitionBy("shard").parquet(root)
    return {k: [f"{root}/shard={k}"] for k in present}


def rewrite(
    spark: SparkSession, layout: Mapping[int, Sequence[str]], shards: int, root: str, **costs
) -> tuple[dict[int, list[str]], list[int]]:
    """Rebalance files: the new folders by shard, and the old shards whose files were rewritten.

    Only shards that lose rows are rewritten, without those rows, under ``root``; the rows come to their new shards
    in files of their own. Folders of other shards are named as they are, so nothing is copied that stays.
    The files must have ``doc_id`` and ``text``; all their columns are kept. ``root`` must not exist.
    """
    every = read_layout(spark, layout)
    key = ["_file", "_row"]
    named = every.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
    rows = stage(named.select(*measured(every), "shard", *key), "sizes")
    placed = place(rows, lambda total: even(total, shards), **costs)
    moved = stage(placed.filter("shard <> new_shard").select(*key, "new_shard", "shard"), "moved")
    losing = sorted(r["shard"] for r in moved.select("shard").distinct().collect())  # one row per shard
    if not losing:
        return {k: list(v) for k, v in layout.items()}, []
    affected = named.filter(F.col("shard").isin(losing))
    goes = moved.select(*key, "new_shard")
    after = affected.join(goes, key, "left").withColumn("shard", F.coalesce("new_shard", "shard"))
    written = write_layout(after.drop("new_shard", *key), root)
    kept = {k: list(v) for k, v in layout.items() if k not in losing}
    return {k: kept.get(k, []) + written.get(k, []) for k in sorted({*kept, *written})}, losing
