"""Labelled training samples: bounded, without held-out rows, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id falls into no training fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, as (text, n_chars, y).

    Rows with a null id or label are left out; the id only selects. The chosen ids are broadcast: their number
    is bounded by ``rows``.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
    once = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    size = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    picked = docs.select(F.col("doc_id"), F.col("text"), size.cast("double").alias("n_chars"))
    return picked.join(F.broadcast(chosen), "doc_id").select("text", "n_chars", "y")
