"""Spans of regular expressions in code points, from built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY = "array<struct<kind:string,nth:int,gap:int,match:string,left:string,right:string>>"


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, a cheap test that every text with a match passes, and context groups."""

    name: str
    pattern: str
    may: str  # SQL over the column ``text``
    left: int = 0  # group of the word before; 0: none
    right: int = 0


def _matches(kind: Kind) -> Column:
    text, pattern = F.col("text"), F.lit(kind.pattern)
    group = lambda n: F.regexp_extract_all(text, pattern, F.lit(n))
    # what lies between the matches, so that their places are running sums of lengths
    arrays = [F.split(text, kind.pattern, -1).alias("gap"), group(0).alias("match")]
    if kind.left:
        arrays += [group(kind.left).alias("left"), group(kind.right).alias("right")]
    zipped = F.filter(F.arrays_zip(*arrays), lambda x: x["match"].isNotNull())
    found = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind.name).alias("kind"),
            i.alias("nth"),
            F.length(x["gap"]).alias("gap"),
            x["match"].alias("match"),
            (x["left"] if kind.left else F.lit("")).alias("left"),
            (x["right"] if kind.left else F.lit("")).alias("right"),
        ),
    ).cast(EMPTY)
    return F.coalesce(F.when(F.expr(kind.may), found), F.array().cast(EMPTY))


def find(docs: DataFrame, kinds: list[Kind], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, key, kind, start, stop, match, left, right): leftmost non-overlapping matches of every kind.

    ``row`` numbers the rows of ``docs``, ``key`` is a hash of the text; a row without any match has one line with a null kind. A null text is
    empty. ``stop`` is exclusive.
    """
    named = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    listed = named.select("row", "doc_id", "key", F.concat(*[_matches(k) for k in kinds]).alias("found"))
    rows = listed.selectExpr("row", "doc_id", "key", "inline_outer(found)")
    upto = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("match")).over(upto)
    start = (stop - F.length("match")).alias("start")
    return rows.select("row", "doc_id", "key", "kind", start, stop.alias("stop"), "match", "left", "right")


def covered(sure: Column) -> Column:
    """Whether a span of its row for which ``sure`` holds overlaps the (other) span."""
    order = Window.partitionBy("row").orderBy("start", "stop")
    before = F.max(F.when(sure, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(sure, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("stop"), F.lit(False))


def told(place: list[str], when: Column | None = None) -> Column:
    """The grouped spans as ``kind:start:end``, by start and then in the order of ``place``, comma-joined."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(place) for x in (k, i)]), F.col("kind"))
    span = F.struct("start", order.alias("place"), "stop", "kind")
    every = F.array_sort(F.collect_list(F.when(when if when is not None else F.col("kind").isNotNull(), span)))
    return F.array_join(
        F.transform(every, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ","
    )


def redact(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with the spans (array of structs with start and stop) replaced by ``mark``; overlapping ones merge."""
    start = "array<struct<start:bigint,stop:bigint>>"
    merged = F.aggregate(
        F.array_sort(spans),
        F.array().cast(start),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] < F.element_at(done, -1)["stop"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))),
    )
    opens = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda x: x["stop"]))
    closes = F.concat(F.transform(merged, lambda x: x["start"]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(
        opens, closes, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    )
    return F.array_join(pieces, mark)
