"""Line dedup by content-defined chunks: repeated runs of lines go, wherever they stand in a document.

A rolling hash over the last ``WINDOW`` line hashes ends a chunk where it is 0 modulo ``DIVISOR``, so that the
same passage is cut alike after lines were put in before it. Chunks of two or more lines whose bytes occur
before (by doc_id, then place) are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.llm import text as tx
from recloom.sources.staging import stage

WINDOW, DIVISOR, LEAST_LINES = 2, 4, 2


def _cuts(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The first line of every chunk; the lines of a document are consecutive."""
    rolled = np.zeros(len(hashes), np.uint64)
    for back in range(WINDOW):
        same = np.zeros(len(hashes), bool)
        same[back:] = doc[back:] == doc[: len(doc) - back]
        shifted = np.zeros(len(hashes), np.uint64)
        shifted[back:] = hashes[: len(hashes) - back]
        rolled += np.where(same, shifted, np.uint64(0)) * np.uint64(2 * back + 1)
    ends = tx.mix(rolled) % np.uint64(DIVISOR) == 0
    opens = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    out, start = [], 0
    for i in np.flatnonzero(opens | np.concatenate(([False], ends[:-1]))).tolist() if len(doc) else []:
        if opens[i] or i - start >= LEAST_LINES:
            out.append(i)
            start = i
    return np.array(out, np.int64)


def chunks(docs: DataFrame, with_body: bool) -> DataFrame:
    """(doc_id, key, text) as one row per chunk of several lines: its code points and hash, on wish its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tx.column(batch, "text")
            for a, b in tx.chunks(texts):
                part = texts.slice(a, b - a)
                starts, ends, doc, hashes = tx.words(part, tx.NEWLINE, tx.EXACT)
                raw, at = tx.flat(part)
                point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                first = _cuts(hashes, doc)
                last = np.concatenate((first[1:], [len(doc)]))[: len(first)] - 1
                begin, own = starts[first], doc[first]
                # a chunk takes the line ends after it along
                after = np.concatenate((begin[1:], [len(raw)]))[: len(first)]
                after = np.minimum(after, at[own + 1])
                running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tx.mix(hashes), dtype=np.uint64)))
                several = last - first + 1 >= LEAST_LINES
                n = np.flatnonzero(several)
                rows = own[n]
                position = np.arange(len(first)) - np.searchsorted(own, own)
                # the order of the lines counts too: mix in the bytes from the first to the last line
                _, _, _, total = tx.bounds(part, tx.NEWLINE, tx.EXACT)
                digest = tx.mix(tx.span_hash(total, begin, ends[last]) + running[last + 1] - running[first])
                out = [
                    batch.column(0).slice(a, b - a).take(pa.array(rows)),
                    batch.column(1).slice(a, b - a).take(pa.array(rows)),
                    pa.array(position[n].astype(np.int32)),
                    pa.array((point[begin[n]] - point[at[rows]]).astype(np.int32)),
                    pa.array((point[after[n]] - point[at[rows]]).astype(np.int32)),
                    pa.array((last - first + 1)[n].astype(np.int32)),
                    pa.array(digest[n].view(np.int64)),
                ]
                if with_body:
                    data = raw.tobytes()
                    spans = zip(begin[n].tolist(), ends[last[n]].tolist(), strict=True)
                    out.append(pa.array([data[x:y] for x, y in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, key long, chunk int, start int, stop int, lines int, hash long"
    names = ["doc_id", "key", "chunk", "start", "stop", "lines", "hash"] + ["body"] * with_body
    return docs.select("doc_id", "key", "text").mapInArrow(run, schema + ", body binary" * with_body)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """The chunks to remove from (doc_id, key, text): every occurrence but the first of equal bytes.

    Equal chunks are combined in the map tasks before the shuffle, by their bytes. Chunks whose hash two
    different texts share stay.
    """
    bodies = chunks(docs, True).groupBy("hash", "body").agg(F.count("*").alias("n"))
    often = bodies.groupBy("hash").agg(F.count("*").alias("texts"), F.max("n").alias("n"))
    often = often.filter("texts = 1 and n > 1").select("hash")
    found = stage(chunks(docs, False).join(often, "hash", "left_semi"), "repeated")
    place = F.struct("doc_id", "key", "chunk")
    first = found.groupBy("hash").agg(F.min(place).alias("first"))
    return found.join(first, "hash").filter(~place.eqNullSafe(F.col("first"))).drop("first", "hash")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut from the text, and the last columns lines_removed, chars_removed.

    All rows and other columns stay; columns named like the two new ones are replaced. A null text stays null,
    a text of single lines or without words is left as it is. Rows that repeat both id and text are treated
    alike, as one document. Null ids come first.
    """
    taken = {c.lower() for c in docs.columns}
    new = [c for c in ("lines_removed", "chars_removed") if c in taken]
    docs = docs.drop(*new)
    packed = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.col(f"row.{id_col}").cast("long").alias("doc_id"),
        F.col(f"row.{text_col}").alias("text"),
        F.xxhash64(f"row.{text_col}").alias("key"),
    )
    cut = repeated_chunks(packed).groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.collect_set(F.struct("chunk", "lines")).alias("gone"),
    ).select(F.col("doc_id").alias("cut_id"), F.col("key").alias("cut_key"), "spans", "gone")
    joined = packed.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("key") == F.col("cut_key")), "left")
    opens = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["stop"]))
    closes = F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.length("text")))
    pieces = F.zip_with(opens, closes, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    gone = F.aggregate("gone", F.lit(0).cast("long"), lambda s, x: s + x["lines"])
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        F.coalesce(gone, F.lit(0)).alias("lines_removed"),
        F.coalesce(lost, F.lit(0)).alias("chars_removed"),
    )
