"""The corpus pipeline: toxic documents go, repeated runs of lines go, one document of each near-duplicate group
stays, secrets are blanked, the rest is packed into sequences.

Stages are ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.llm import line_runs, minhash_join, packing, secrets, toxicity
from recloom.llm.queries import corpus_session, table
from recloom.operators.positions import positions
from recloom.sources.staging import stage


def _with_length(docs: DataFrame) -> DataFrame:
    """Bring n_chars in line with a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model trained on the labels of these documents.

    Null and empty texts score as a text without words; repeated rows and null ids are scored like others.
    """
    corpus_session(spark)
    model, score = toxicity.train(docs, table(spark, sf_dir, "labels")), _free(docs, "toxicity")
    return toxicity.score(docs, model, out=score).filter(F.col(score) < 0.5).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without runs of lines that occur before; emptied documents stay as empty texts.

    Null texts stay null. Columns named like those that the operator adds are kept.
    """
    corpus_session(spark)
    added = ("lines_removed", "chars_removed")
    hidden = {c: _free(docs, f"kept_{c.lower()}") for c in docs.columns if c.lower() in added}
    cut = line_runs.dedup_runs(docs.withColumnsRenamed(hidden)).drop(*added)
    return _with_length(cut.withColumnsRenamed({new: old for old, new in hidden.items()}).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; all of those that link with nothing.

    A document is an id with its text: rows that share both stay or go together, and rows that share an id only are
    documents of their own (numbered after all others). Rows with null ids, and null or empty texts, stay.
    """
    corpus_session(spark)
    node, key = _free(docs, "node"), _free(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    ids = keyed.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.max("doc_id").alias("most"))
    ids = stage(ids, "ids")
    several = ids.filter("low <> high and doc_id is not null").select("doc_id")
    texts = keyed.select("doc_id", F.col(key).alias("own_key")).join(several, "doc_id", "left_semi").distinct()
    placed = positions(texts, [], ["doc_id", "own_key"], "several-texts")
    most = ids.agg(F.max("most")).first()[0] or 0
    fresh = placed.select(F.col("doc_id").alias("own_id"), "own_key", (F.col("pos") + most + 1).alias("own_node"))
    same = (F.col("doc_id") == F.col("own_id")) & (F.col(key) == F.col("own_key"))
    named = keyed.join(fresh, same, "left").withColumn(node, F.coalesce("own_node", "doc_id"))
    gone = minhash_join.near_duplicates(named.select(node, "text"), id_col=node).filter(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("gone_node")).distinct()
    return named.join(gone, F.col(node) == F.col("gone_node"), "left_anti").select(*docs.columns)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark. Null texts stay null; equal rows are treated alike."""
    corpus_session(spark)
    return _with_length(secrets.redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null or empty text is its end token alone."""
    corpus_session(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near duplicates", drop_near_duplicates),
    ("secrets", blank_secrets),
    ("packing", pack),
]
# Decoding, repeated runs, MinHash and tokens are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written to the shared folder for the next."""
    corpus_session(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
