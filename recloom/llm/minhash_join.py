"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

A document is posted under its coordinate-value pairs. Two signatures of ``COORDINATES`` values that agree
in ``MATCHES`` or more share one of each other's ``COORDINATES - MATCHES + 1`` rarest pairs, so only that
prefix is posted; pairs nobody else has fill it first and are skipped. Collisions are then counted over
whole signatures and links confirmed on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recloom.llm import text as tx
from recloom.llm.components import components
from recloom.llm.staging import stage_rows
from recloom.sources.staging import stage

# At a similarity of 0.75 a signature of 64 agrees in fewer than 32 places once in about 100,000 pairs.
COORDINATES, MATCHES = 64, 32
SHINGLE, PERCENT = 5, 75
BROADCAST_IDS = 100_000  # ids of 8 bytes
BLOCK = 500_000  # shingles that a task holds of each side

_SEEDS = tx.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))
_FACTORS = tx.mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64)) | np.uint64(1)


def _long_lists(parts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(parts.view(np.int64)))


def _signed(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sizes, two hashes and the signatures (coordinate in the low 6 bits) of shingle sets; empty ones have none."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    prints = np.zeros((2, len(sets)), np.uint64)
    signature = np.zeros((len(full), COORDINATES), np.uint64)
    if len(full):
        every = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for k in range(2):
            prints[k, full] = np.add.reduceat(tx.mix(every ^ _SEEDS[k]), starts)
        for k in range(COORDINATES):
            least = np.minimum.reduceat((every ^ _SEEDS[k]) * _FACTORS[k], starts)
            signature[:, k] = (tx.mix(least) & ~np.uint64(63)) | np.uint64(k)
    return sizes, prints[0], prints[1], signature


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Per document: n_shingles, two hashes of its shingle set and its MinHash signature (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tx.column(batch, "text")
            for a, b in tx.chunks(texts):
                sizes, one, two, signature = _signed(tx.shingles(texts.slice(a, b - a), size))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(sizes),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        _long_lists(signature.ravel(), COORDINATES * (sizes > 0)),
                    ],
                    ["doc_id", "n_shingles", "print1", "print2", "signature"],
                )

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "doc_id long, n_shingles long, print1 long, print2 long, signature array<long>")


def _marks(ids: DataFrame, bits: int = 23) -> np.ndarray:
    """A bitmap of fixed size (2^``bits`` bits) with a bit for the hash of every id."""
    word, bit = F.expr(f"shiftright(h, 5) & {(1 << bits - 5) - 1}"), F.expr("shiftleft(1L, int(h & 31))")
    rows = ids.select(F.xxhash64("rep").alias("h")).groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).collect()
    marks = np.zeros(1 << bits - 5, np.uint32)
    marks[[r["w"] for r in rows]] = [r["b"] for r in rows]
    return marks


def evidence(docs: DataFrame, posted: DataFrame, size: int) -> DataFrame:
    """The whole shingle sets of posted documents and their signatures: (rep, shingles, signature).

    A bitmap of bounded size keeps most other texts from being shingled; the join then decides.
    """
    wanted = posted.select("rep").distinct()
    marks = _marks(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2).to_numpy()
            asked = np.flatnonzero(marks[(h >> 5) & (len(marks) - 1)] >> (h & 31).astype(np.uint32) & 1)
            batch = batch.take(pa.array(asked))
            texts = tx.column(batch, "text")
            for a, b in tx.chunks(texts):
                sets = tx.shingles(texts.slice(a, b - a), size)
                lists = _long_lists(np.concatenate(sets), np.array([len(s) for s in sets]))
                sizes, _, _, signature = _signed(sets)
                signature = _long_lists(signature.ravel(), COORDINATES * (sizes > 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), lists, signature], ["rep", "shingles", "signature"]
                )

    named = docs.filter("doc_id is not null").select(F.col("doc_id").alias("rep"), "text")
    sets = named.withColumn("h", F.xxhash64("rep")).mapInArrow(
        run, "rep long, shingles array<long>, signature array<long>"
    )
    return stage_rows(sets.join(wanted, "rep", "left_semi"), "sets", wanted.count(), 5_000)


def prefixes(reps: DataFrame, matches: int = MATCHES) -> DataFrame:
    """The posted part of each signature: its rarest pairs, without those nobody shares.

    (key, rep, n, hub): ``hub`` says how common the whole signature is; the original of many copies is ahead.
    """
    postings = reps.select("rep", "n", F.explode("signature").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = postings.join(shared, "key").groupBy("rep", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "key"))).alias("pairs"), F.sum("df").alias("hub")
    )
    # pairs that nobody shares are the rarest of all and use up the prefix first
    left = F.greatest(F.lit(COORDINATES - matches + 1) - (COORDINATES - F.size("pairs")), F.lit(0))
    listed = ranked.select("rep", "n", "hub", F.explode(F.slice("pairs", 1, left)).alias("pair"))
    return listed.select("pair.key", "rep", "n", "hub")


class Grouping:
    """Components of posted documents, grown link by link."""

    def __init__(self, posted: DataFrame, sets: DataFrame, percent: int, matches: int):
        self.posted, self.sets, self.percent, self.matches = posted, sets, percent, matches
        self.rows = posted.count()  # bounds all that follows
        self.labels = posted.select("rep").distinct().withColumn("component", F.col("rep"))

    def open_lists(self) -> DataFrame:
        """Postings of the lists that still hold several components, with their component."""
        labelled = self.posted.join(self.labels, "rep")
        mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        return stage_rows(labelled.join(mixed.filter("lo <> hi").select("key"), "key", "left_semi"), "lists", self.rows)

    def join_leaders(self) -> None:
        """Compare the members of each list with its commonest signature (ties: smallest id)."""
        order = F.struct((-F.col("hub")).alias("o"), "rep", "n")
        pairs = self.posted.join(self.posted.groupBy("key").agg(F.min(order).alias("x")), "key")
        pairs = pairs.filter("rep <> x.rep").filter(
            F.least("n", "x.n") * 100 >= F.greatest("n", "x.n") * self.percent
        )
        pairs = pairs.select(F.least("rep", "x.rep").alias("a"), F.greatest("rep", "x.rep").alias("b")).distinct()
        pairs = stage_rows(pairs, "pairs", self.rows)
        close = pairs
        for x in "ab":
            signed = self.sets.select(F.col("rep").alias(x), F.col("signature").alias(f"s{x}"))
            close = close.join(_those(signed, pairs, x), x)
        close = close.filter(F.size(F.array_intersect("sa", "sb")) >= self.matches).select("a", "b")
        for x in "ab":
            sets = self.sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}"))
            close = close.join(_those(sets, pairs, x), x)
        close = close.withColumn("common", F.size(F.array_intersect("sa", "sb")))
        alike = F.col("common") * 100 >= (F.size("sa") + F.size("sb") - F.col("common")) * self.percent
        self._merge(close.filter(alike).select("a", "b"))

    def join_rest(self) -> None:
        """Compare what is left: members of different components that share a list.

        Documents tied together by open lists form a cluster. Those outside its largest component are probes:
        each meets every document of the cluster, block by block, so no task holds more than two blocks.
        """
        lists = self.open_lists()
        first = lists.groupBy("key").agg(F.min("rep").alias("a"))
        tied = lists.join(first, "key").select("a", F.col("rep").alias("b")).distinct()
        clusters = components(tied, self.rows).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
        members = lists.select("rep", "n", "component").distinct().join(clusters, "rep")
        members = stage_rows(members, "members", self.rows)
        sizes = members.groupBy("cluster", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        largest = F.max(F.struct("c", (-F.col("component")).alias("main"), "n"))
        shape = sizes.groupBy("cluster").agg(largest.alias("top"), F.sum("n").alias("all")).select(
            "cluster",
            (-F.col("top.main")).alias("main"),
            F.ceil(F.col("all") / BLOCK).alias("blocks"),
            F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("chunks"),
        )
        full = members.join(shape, "cluster").join(self.sets, "rep")
        spread = lambda by, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(by))
        upto = lambda by: F.explode(F.sequence(F.lit(0).cast("long"), F.col(by) - 1))
        columns = ["cluster", "block", "chunk", "probe", "rep", "component", "shingles", "signature"]
        home = full.withColumns({"block": spread("blocks", 1), "probe": F.lit(False)})
        home = home.withColumn("chunk", upto("chunks")).select(*columns)
        probe = full.filter("component <> main").withColumns({"chunk": spread("chunks", 2), "probe": F.lit(True)})
        probe = probe.withColumn("block", upto("blocks")).select(*columns)
        cells = home.unionByName(probe).groupBy("cluster", "block", "chunk")
        percent, matches = self.percent, self.matches
        self._merge(cells.applyInArrow(lambda cell: _cell_links(cell, percent, matches), "a long, b long"), lifted=True)

    def _merge(self, links: DataFrame, lifted: bool = False) -> None:
        """Merge the components that ``links`` between documents (lifted: between components) join."""
        if not lifted:
            for x in "ab":
                named = self.labels.select(F.col("rep").alias(x), F.col("component").alias(f"c{x}"))
                links = links.join(named, x)
            links = links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components(links, self.rows)
        renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("new"))
        labels = self.labels.join(renamed, "component", "left")
        labels = labels.select("rep", F.coalesce("new", "component").alias("component"))
        self.labels = stage_rows(labels, "labels", self.rows)


def _lists(table: pa.Table, name: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column at some rows, and the position (in ``rows``) each belongs to."""
    lists = table.column(name).combine_chunks().take(pa.array(rows))
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(rows)), sizes)


def _cell_links(cell: pa.Table, percent: int, matches: int) -> pa.Table:
    """Links between components in one cell, enough of them to tie what belongs together.

    Collisions are counted by merging the posting lists of a probe's signature; what reaches ``matches`` is
    confirmed by merging the posting lists of its whole set. Documents already tied are skipped.
    """
    probe = cell.column("probe").to_numpy()
    component, rep = cell.column("component").to_numpy(), cell.column("rep").to_numpy()
    homes, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
    index = {}
    for name in ("signature", "shingles"):
        values, owner = _lists(cell, name, homes)
        order = np.argsort(values, kind="stable")
        index[name] = values[order], owner[order]
    sizes = np.bincount(_lists(cell, "shingles", homes)[1], minlength=len(homes))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    def counts(name: str, mine: np.ndarray) -> np.ndarray:
        values, owner = index[name]
        lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        lo, n = lo[hi > lo], (hi - lo)[hi > lo]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=len(homes))

    out = []
    for p in probes.tolist():
        own = _lists(cell, "signature", np.array([p]))[0]
        near = (counts("signature", own) >= matches) & (component[homes] != component[p]) & (rep[homes] != rep[p])
        if not near.any():
            continue
        mine = _lists(cell, "shingles", np.array([p]))[0]
        common = counts("shingles", mine)
        near &= common * 100 >= (sizes + len(mine) - common) * percent
        for other in np.unique(component[homes[near]]).tolist():
            a, b = root(int(component[p])), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((min(a, b), max(a, b)))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _those(table: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """The rows of ``table`` that ``pairs`` ask for; a short list of ids is broadcast, a long one joined."""
    ids = pairs.select(column).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return table.join(ids, column, "left_semi")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    matches: int = MATCHES,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Equal sets are one class. The members of a posting list are first compared with the commonest signature in
    it; then, where lists still hold several components, with the members of the others. So a group of n alike
    copies costs a few n comparisons, and no link that joins two components is missed.

    Null or empty texts have no shingles and link with nothing. Rows with a null id get a null component and
    are kept. Rows that repeat an id are one document. An empty table gives an empty result; other columns
    are ignored.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(signatures(named, size=size), "signatures")
    prints = ["print1", "print2", "n_shingles"]
    grouped = signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*prints)
    classes = grouped.agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    classes = stage_rows(classes, "classes", signed.count(), 20_000)
    reps = classes.select("rep", F.col("n_shingles").alias("n"), "signature")
    posted = stage_rows(prefixes(reps, matches), "posted", classes.count())
    grouping = Grouping(posted, evidence(named, posted, size), percent, matches)
    grouping.join_leaders()
    grouping.join_rest()

    final = classes.select(*prints, "rep").join(grouping.labels, "rep", "left")
    final = final.select(*prints, F.coalesce("component", "rep").alias("found"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return signed.join(final, prints, "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
