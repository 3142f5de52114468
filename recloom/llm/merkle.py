"""Merkle manifest of a data set by checkpoint-and-recompute.

Rows are leaves, every ``FANOUT`` consecutive nodes of a group make their parent, the groups' roots make the root.
Only the leaves and every ``EVERY``-th level above are written. A proof needs the levels between, too: each aligned
subtree between two written levels is built again from its lower nodes, gives the siblings and is forgotten.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recloom.operators.positions import positions
from recloom.sources.staging import stage

FANOUT, EVERY = 16, 2
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex sha256; an empty input has one too."""
    return F.sha2(text.cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """The digest of a row: every value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    told = [v.cast("string") for v in values]
    return digest(
        F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in told])
    )


def tree_key(group: Column) -> Column:
    """A name of the group that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def _count(level: int) -> Column:
    """Nodes of the whole tree at a level."""
    size = FANOUT**level
    return F.expr(f"(n + {size - 1}L) div {size}L")


def _up(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))


def _subtrees(nodes: DataFrame, level: int) -> DataFrame:
    """One row per aligned subtree above ``nodes``: tree, block, n, its nodes and its levels d0 ... d``EVERY``.

    A subtree has at most ``FANOUT ** EVERY`` nodes; above the root of its tree a level repeats it.
    """
    rest = [c for c in nodes.columns if c not in ("tree", "pos", "n")]
    block = F.expr(f"pos div {FANOUT**EVERY}L").alias("block")
    rows = nodes.filter(_count(level) > 1).groupBy("tree", block)
    rows = rows.agg(F.any_value("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("nodes"))
    rows = rows.withColumn("d0", F.transform("nodes", lambda x: x["digest"]))
    for k in range(EVERY):
        here = F.col(f"d{k}")
        rows = rows.withColumn(f"d{k + 1}", F.when(_count(level + k) > 1, _up(here)).otherwise(here))
    return rows


@dataclass
class Tree:
    """Trees over placed leaves: ``levels[i]`` holds the nodes (tree, pos, n, digest) of level ``i * EVERY``."""

    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        tops = [
            nodes.filter(_count(i * EVERY) == 1).select("tree", "digest") for i, nodes in enumerate(self.levels)
        ]
        return reduce(DataFrame.unionByName, tops)

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves with their columns, those that ``above`` (tree, path, ...) has for their tree, and their whole
        path: the siblings left and right of the way up, level by level, then the path that ``above`` has."""
        taken = [c for c in above.columns if c not in ("tree", "path")]
        lone = self.levels[0].filter("n = 1").join(above, "tree")
        upper, out = None, None
        for i in reversed(range(len(self.levels) - 1)):
            level = i * EVERY
            rows = _subtrees(self.levels[i], level)
            # the tree ends with this subtree, or goes on in the level written above
            ends = rows.filter(_count(level + EVERY) == 1).join(above, "tree")
            if upper is not None:
                goes_on = rows.filter(_count(level + EVERY) > 1).join(upper, ["tree", "block"])
                ends = ends.unionByName(goes_on)
            listed = ends.select("tree", "n", "path", *taken, F.inline(_with_siblings(level)))
            nodes = listed.withColumn("path", F.concat("own", "path")).drop("own")
            if i:
                upper = nodes.select("tree", F.col("pos").alias("block"), "path", *taken)
                upper = stage(upper, f"proofs-{level}")
            else:
                out = nodes
        return lone if out is None else out.unionByName(lone.select(*out.columns))


def _with_siblings(level: int) -> Column:
    """The nodes of a subtree, each with its own part of the path."""

    def one(i: Column) -> Column:
        steps = []
        for k in range(EVERY):
            here, at = F.col(f"d{k}"), F.floor(i / FANOUT**k).cast("int")
            inside = at % FANOUT
            left = F.array_join(F.slice(here, at - inside + 1, inside), "")
            right = F.array_join(F.slice(here, at + 2, F.lit(FANOUT - 1) - inside), "")
            steps.append(F.when(_count(level + k) > 1, F.struct(left.alias("left"), right.alias("right"))))
        return F.filter(F.array(*steps), lambda x: x.isNotNull()).cast(PATH)

    return F.transform("nodes", lambda x, i: x.withField("own", one(i)))


def grow(placed: DataFrame) -> Tree:
    """Write every ``EVERY``-th level above placed leaves (tree, pos, n, digest, ...)."""
    levels, most = [placed], placed.agg(F.max("n")).first()[0] or 0
    while FANOUT ** ((len(levels) - 1) * EVERY) < most:
        level = (len(levels) - 1) * EVERY
        rows = _subtrees(levels[-1].select("tree", "pos", "n", "digest"), level)
        up = rows.select("tree", F.col("block").alias("pos"), "n", F.col(f"d{EVERY}")[0].alias("digest"))
        levels.append(stage(up, f"nodes-{level + EVERY}"))
    return Tree(levels)


@dataclass
class Manifest:
    """The groups' trees, the tree over their roots, and its root (None without leaves)."""

    groups: Tree
    top: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """The leaves with their columns, ``tree``, ``subroot`` and ``path`` (see ``Tree.paths``) up to the root."""
        nothing = F.array().cast(PATH)
        start = self.top.levels[0].select("tree").limit(1).withColumn("path", nothing)
        above = self.top.paths(start).select(
            F.col("own_tree").alias("tree"), F.col("digest").alias("subroot"), "path"
        )
        return self.groups.paths(stage(above, "subroot-paths")).drop("pos", "n")


def build(leaves: DataFrame, order: list[str]) -> Manifest:
    """The manifest of ``leaves`` (tree, digest, ... as made by ``tree_key`` and ``leaf``), in each tree by ``order``.

    Rows that repeat are leaves of their own; rows that tie in ``order`` come by their digests. No leaves give no
    root. Other columns are carried along to the proofs; they must not be named like ``tree, digest, pos, n``.
    """
    groups = grow(positions(leaves, ["tree"], [*order, "digest"], "leaves"))
    subroots = groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("own_tree"), "digest")
    top = grow(positions(subroots, ["tree"], ["own_tree"], "subroots"))
    root = top.roots().first()
    return Manifest(groups, top, root["digest"] if root else None)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from below, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest leads to along its path."""
    return F.aggregate(path, start, lambda node, x: digest(F.concat(x["left"], node, x["right"])))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def audit(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents`` and the check of each proof, against rows of which some were tampered with.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Where 5 divides the crc32 of the id,
    the row is checked with its text in lower case (A-Z only). Nulls in any column are told apart from empty values;
    a row with a null id comes first in its source and is not tampered with. Rows that repeat are leaves of their
    own. Texts of any length are hashed whole; other columns are ignored; an empty table gives an empty result.
    """
    columns = [F.col(c) for c in COLUMNS]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    altered = F.when(chosen, leaf([*columns[:-1], F.translate("text", upper, lower)]))
    leaves = docs.select(
        tree_key(F.col("source")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(columns).alias("digest"),
        altered.alias("altered"),
    )
    manifest = build(leaves, ["doc_id"])
    root = F.lit(manifest.root).cast("string")
    checked = manifest.proofs().select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("altered", "digest"), F.col("path")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == root)
