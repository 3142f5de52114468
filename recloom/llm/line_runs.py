"""Line dedup by content-defined chunks: every run of units that stands at an earlier place goes, however it is cut.

A unit is a line; a line of more than ``LONG`` words is cut into its sentences. A run counts if it has two or more
units, or is one unit of more than ``LONG`` words. Texts are cut at two levels: into chunks, which end where a rolling
hash of the last units is 0 modulo ``DIVISOR``, and into single units. Chunks are compared by their bytes, and later
copies go whole. In all others units are compared by their bytes; equal ones that have equal neighbours make up the
rest of the runs, so shifted, short and partial copies are found whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from recloom.llm import text as tx
from recloom.sources.staging import stage

LONG = 50
DIVISOR = 4
# A bitmap of repeated hashes has 8 bits for each of them, and at most 2 to this power (32 MB).
MOST_BITS = 28
SPANS = ArrayType(StructType().add("start", "integer").add("stop", "integer").add("whole", "boolean"))
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _within(words: np.ndarray, begin: np.ndarray, close: np.ndarray) -> np.ndarray:
    """How many of the sorted places ``words`` lie in each span."""
    return np.searchsorted(words, close) - np.searchsorted(words, begin)


def _units(part: pa.Array) -> tuple[np.ndarray, ...]:
    """Start, end (bytes), line (over all texts), text number, words and rolling hash of every unit."""
    raw, at = tx.flat(part)
    starts, ends, doc, total = tx.bounds(part, tx.NEWLINE, tx.EXACT)
    space = tx.SPACE[raw]
    opens = np.concatenate(([True], space[:-1]))[: len(raw)]
    opens[at[:-1][at[:-1] < len(raw)]] = True
    words = np.flatnonzero(opens & ~space)
    long = _within(words, starts, ends) > LONG
    stops = np.flatnonzero(_STOP[raw[:-1]] & space[1:]) if long.any() else np.zeros(0, np.int64)
    line = np.searchsorted(starts, stops, "right") - 1
    after = np.searchsorted(words, stops + 1)
    inside = (line >= 0) & (after < len(words))
    inside[inside] = long[line[inside]] & (words[after[inside]] < ends[line[inside]])
    begin = np.concatenate((starts, words[after[inside]]))
    order = np.argsort(begin, kind="stable")
    begin, line = begin[order], np.concatenate((np.arange(len(starts)), line[inside]))[order]
    # a unit ends with its line or at the stop before the next unit
    close = ends[line]
    cut = np.flatnonzero(line[1:] == line[:-1])
    close[cut] = stops[inside]
    close[cut] += 1
    return begin, close, line, doc[line], _within(words, begin, close), tx.span_hash(total, begin, close)


def _cuts(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last unit of every chunk; the last one opens the next chunk of the text, if there is one.

    All but the last chunk of a text have two or more units of their own.
    """
    opens = np.concatenate(([True], doc[1:] != doc[:-1]))
    rolled = hashes * np.uint64(3) + np.concatenate((hashes[:1], hashes[:-1]))
    ends = (tx.mix(rolled) % np.uint64(DIVISOR) == 0) & ~opens
    ends[1:] &= ~ends[:-1]
    first = np.flatnonzero(opens | np.concatenate(([False], ends[:-1])))
    last = np.concatenate((first[1:], [len(doc)])) - 1
    after = np.minimum(last + 1, len(doc) - 1)
    return first, np.where(doc[after] == doc[last], after, last)


def _slices(raw: np.ndarray, begin: np.ndarray, close: np.ndarray) -> list[bytes]:
    data = raw.tobytes()
    return [data[x:y] for x, y in zip(begin.tolist(), close.tolist(), strict=True)]


@dataclass
class _Cut:
    """Units, chunks (``first`` to ``upto``) and windows (pairs of neighbours, then long units alone) of some texts."""

    begin: np.ndarray
    close: np.ndarray
    doc: np.ndarray
    own: np.ndarray  # hash of every unit
    first: np.ndarray
    upto: np.ndarray
    inner: np.ndarray  # the units of all chunks
    edge: np.ndarray
    hashed: np.ndarray  # hash of every chunk
    opens: np.ndarray  # first unit of every window
    size: np.ndarray  # and its units
    window: np.ndarray  # and its hash


def _cut(part: pa.Array, salt: int, bits: int) -> _Cut:
    raw, _ = tx.flat(part)
    begin, close, _, doc, words, rolling = _units(part)
    if salt:
        mark, digest = salt.to_bytes(8, "little"), hashlib.blake2b
        joined = b"".join([digest(x, digest_size=8, salt=mark).digest() for x in _slices(raw, begin, close)])
        own = np.frombuffer(joined, np.uint64)
    else:
        own = rolling & np.uint64((1 << bits) - 1)
    first, upto = _cuts(rolling, doc) if len(doc) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    units = upto - first + 1
    edge = np.concatenate(([0], np.cumsum(units)))
    inner = np.repeat(first - edge[:-1], units) + np.arange(edge[-1])
    nth = (np.arange(edge[-1]) - np.repeat(edge[:-1], units)).astype(np.uint64)
    hashed = tx.mix(np.add.reduceat(tx.mix(own[inner] + tx.mix(nth + np.uint64(1))), edge[:-1])) if len(first) else own[:0]
    pair, alone = np.flatnonzero(doc[1:] == doc[:-1]), np.flatnonzero(words > LONG)
    window = np.concatenate((tx.mix(own[pair] * np.uint64(3) + tx.mix(own[pair + 1])), tx.mix(~own[alone])))
    size = np.repeat(np.array([2, 1]), [len(pair), len(alone)])
    return _Cut(begin, close, doc, own, first, upto, inner, edge, hashed, np.concatenate((pair, alone)), size, window)


def hashes(docs: DataFrame, salt: int, bits: int) -> DataFrame:
    """The hashes of all chunks and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tx.column(batch, "text")
            for a, b in tx.chunks(texts):
                cut = _cut(texts.slice(a, b - a), salt, bits)
                told = np.concatenate((cut.window, cut.hashed[cut.upto > cut.first])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(told)], ["hash"])

    return docs.select("text").mapInArrow(run, "hash long")


def _bitmap(often: DataFrame) -> bytes:
    """The hashes as a bitmap of bounded size, by their last bits."""
    power = min(MOST_BITS, max(15, (8 * often.count()).bit_length()))
    bit = F.col("hash").bitwiseAND((1 << power) - 1) + 1
    parts = often.groupBy(F.bitmap_bucket_number(bit).alias("nth")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )
    whole = bytearray(1 << (power - 3))
    for row in parts.toLocalIterator():
        whole[(row.nth - 1) * 4096 : row.nth * 4096] = row.bits
    return bytes(whole)


REPEATED = (
    "hash long, cut binary, body binary, doc_id long, key long, place int, units int, "
    "a array<long>, b array<long>, size array<int>, at array<int>"
)


def repeats(docs: DataFrame, salt: int, bits: int, often: bytes) -> DataFrame:
    """Chunks of (doc_id, key, text) with windows whose hash is in the bitmap ``often``, and the bytes of their units.

    A chunk's ``place`` is the number of its first unit in the text. ``a``, ``b``, ``size`` and ``at`` are the hashes,
    number and place of the units of its windows. If its own hash is in the bitmap too, it has a ``body``, and ``cut``
    says where the units start and end there. Rows without ``units`` are units: hash and body, once per batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8)
        last = np.uint64(8 * len(marks) - 1)

        def known(values: np.ndarray) -> np.ndarray:
            bit = values & last
            return (marks[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in batches:
            texts = tx.column(batch, "text")
            for a, b in tx.chunks(texts):
                part = texts.slice(a, b - a)
                cut, (raw, _) = _cut(part, salt, bits), tx.flat(part)
                seen = np.flatnonzero(known(cut.window))
                seen = seen[np.argsort(cut.opens[seen], kind="stable")]
                opens, size = cut.opens[seen], cut.size[seen]
                of = np.searchsorted(cut.first, opens, "right") - 1
                chunk, counts = np.unique(of, return_counts=True)
                units = (cut.upto - cut.first + 1)[chunk]
                copied = np.flatnonzero(known(cut.hashed[chunk]) & (units > 1))
                lists = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                after = np.where(size == 2, cut.own[np.minimum(opens + 1, len(cut.own) - 1)], np.uint64(0))
                place = np.arange(len(cut.doc)) - np.searchsorted(cut.doc, cut.doc)
                bodies, cuts = [None] * len(chunk), [None] * len(chunk)
                span = zip(*(x[chunk[copied]].tolist() for x in (cut.first, cut.upto, cut.edge, cut.edge[1:])), strict=True)
                base = np.repeat(cut.begin[cut.first], cut.upto - cut.first + 1)
                bounds = np.stack((cut.begin[cut.inner] - base, cut.close[cut.inner] - base), axis=1).astype(np.int32)
                data = raw.tobytes()
                for i, (x, y, p, q) in zip(copied.tolist(), span, strict=True):
                    bodies[i], cuts[i] = data[cut.begin[x] : cut.close[y]], bounds[p:q].tobytes()
                rows = pa.array(cut.doc[cut.first[chunk]])
                out = [pa.array(cut.hashed[chunk].view(np.int64)), pa.array(cuts, pa.binary()), pa.array(bodies, pa.binary())]
                out += [batch.column(i).slice(a, b - a).take(rows) for i in (0, 1)]
                out += [pa.array(x.astype(np.int32)) for x in (place[cut.first[chunk]], units)]
                out += [
                    pa.ListArray.from_arrays(lists, pa.array(x))
                    for x in (cut.own[opens].view(np.int64), after.view(np.int64), size.astype(np.int32), place[opens].astype(np.int32))
                ]
                yield pa.RecordBatch.from_arrays(out, names)
                used = np.unique(np.concatenate((opens, opens[size == 2] + 1)))
                told = zip(cut.own[used].view(np.int64).tolist(), _slices(raw, cut.begin[used], cut.close[used]), strict=True)
                told = list(dict.fromkeys(told))
                none = [pa.nulls(len(told), x.type) for x in out]
                none[0], none[2] = pa.array([h for h, _ in told], pa.int64()), pa.array([x for _, x in told], pa.binary())
                yield pa.RecordBatch.from_arrays(none, names)

    names = [x.split()[0] for x in REPEATED.split(", ")]
    return docs.select("doc_id", "key", "text").mapInArrow(run, REPEATED)


def repeated_units(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The units to remove from (doc_id, key, text), as (doc_id, key, unit): every occurrence of a run but the first.

    An occurrence that overlaps the first one in the same text stays. Equality is that of bytes: were two different
    units to share a hash (of ``bits`` bits at first), all are hashed anew with a salt. Only what has a hash that
    occurs again is compared; a bitmap of these, of bounded size, keeps most of the rest from being moved.
    """
    for salt in count():
        often = hashes(docs, salt, bits).groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
        found = stage(repeats(docs, salt, bits, _bitmap(stage(often.select("hash"), "often"))), "repeated", "zstd")
        # the rows of one hash meet in one task, each body once per batch
        bodies = found.filter("units IS NULL").select("hash", "body").repartition("hash").distinct()
        if bodies.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").count() == 0:
            break
    # coarse: chunks by their bytes; a copy in the same text begins two or more units after the first one
    of_chunk, place = ["hash", "cut", "body"], F.struct("doc_id", "key", "place")
    told = ["doc_id", "key", "place", "units", "a", "b", "size", "at"]
    shared = found.filter("units IS NOT NULL AND body IS NOT NULL")
    first = shared.groupBy(*of_chunk).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    later = F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))
    shared = shared.join(first.drop("n"), of_chunk, "left").select(*told, later.alias("copy"))
    alone = found.filter("units IS NOT NULL AND body IS NULL").select(*told, F.lit(False).alias("copy"))
    chunks = stage(shared.unionByName(alone), "chunks")
    copies = chunks.filter("copy").withColumn("size", F.col("units"))
    # fine: windows of the other chunks
    windows = chunks.filter("NOT copy").select("doc_id", "key", F.inline(F.arrays_zip("a", "b", "size", "at")))
    windows = windows.withColumnRenamed("at", "place")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    first = windows.groupBy("a", "b", "size").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    again = windows.join(first, ["a", "b", "size"]).filter(~same | (F.col("place") - F.col("first.place") >= F.col("size")))
    gone = copies.select("doc_id", "key", "place", "size").unionByName(again.select("doc_id", "key", "place", "size"))
    return gone.select("doc_id", "key", F.explode(F.expr("sequence(place, place + size - 1)")).alias("unit"))


@F.arrow_udf(SPANS)
def _spans(text: pa.Array, gone: pa.Array) -> pa.Array:
    """The code points to cut for the units ``gone`` of each text, in order; a null list gives null.

    What is cut takes the gap to the next unit of its line along; with the last unit the line ends go too, if all units
    of the line go (``whole``).
    """
    valid = gone.is_valid().to_numpy(zero_copy_only=False)
    rows = pa.array(np.flatnonzero(valid))
    texts, lists = text.take(rows).cast(pa.large_string()), gone.take(rows)
    parts = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool))]
    for a, b in tx.chunks(texts):
        part, units_of = texts.slice(a, b - a), lists.slice(a, b - a)
        raw, at = tx.flat(part)
        begin, close, line, doc, _, _ = _units(part)
        counts = units_of.value_lengths().to_numpy(zero_copy_only=False)
        head = np.searchsorted(doc, np.arange(b - a))
        unit = np.sort(np.repeat(head, counts) + units_of.flatten().to_numpy(zero_copy_only=False))
        point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        follow = np.minimum(np.concatenate((begin[1:], [len(raw)])), at[doc + 1])
        ending = np.concatenate((line[1:] != line[:-1], [True]))[unit]
        lost = np.bincount(line[unit], minlength=line[-1] + 1)
        whole = ending & (lost == np.bincount(line))[line[unit]]
        base = point[at[doc[unit]]]
        stop = np.where(~ending | whole, follow[unit], close[unit])
        parts.append(((point[begin[unit]] - base).astype(np.int32), (point[stop] - base).astype(np.int32), whole))
    starts, stops, wholes = (pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))
    spans = pa.StructArray.from_arrays([starts, stops, wholes], ["start", "stop", "whole"])
    sizes = np.zeros(len(gone) + 1, np.int32)
    sizes[1:][valid] = lists.value_lengths().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), spans, mask=pa.array(~valid))


def dedup_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64
) -> DataFrame:
    """``docs`` with repeated runs cut from the text, and the last columns lines_removed, chars_removed.

    All rows and other columns stay; columns named like the two new ones are replaced. A null text stays null; a
    line counts as removed, and takes the line ends after it along, when all of it goes. The first occurrence of
    every unit stays. Rows that repeat both id and text are treated alike, as one document. Null ids come first.
    """
    taken = {c.lower() for c in docs.columns}
    docs = docs.drop(*[c for c in ("lines_removed", "chars_removed") if c in taken])
    packed = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.col(f"row.{id_col}").cast("long").alias("doc_id"),
        F.col(f"row.{text_col}").alias("text"),
        F.xxhash64(f"row.{text_col}").alias("key"),
    )
    cut = repeated_units(packed, bits).groupBy("doc_id", "key").agg(F.collect_set("unit").alias("gone"))
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("key").alias("cut_key"), "gone")
    joined = packed.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("key") == F.col("cut_key")), "left")
    joined = joined.withColumn("spans", _spans("text", "gone"))
    opens = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["stop"]))
    closes = F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.length("text")))
    between = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    pieces = F.transform(
        F.filter(between, lambda x: x["n"] > 0), lambda x: F.substring(F.col("text"), x["a"] + 1, x["n"])
    )
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    zero = F.lit(0).cast("long")
    gone = F.aggregate("spans", zero, lambda s, x: s + x["whole"].cast("long"))
    lost = F.aggregate("spans", zero, lambda s, x: s + x["stop"] - x["start"])
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        F.coalesce(gone, F.lit(0)).alias("lines_removed"),
        F.coalesce(lost, F.lit(0)).alias("chars_removed"),
    )
