"""The registered queries over the corpus tables, with production parameters and over whole tables."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.llm import (
    alignment,
    line_runs,
    merkle,
    metric_join,
    minhash_join,
    packing,
    permutation_index,
    pieces,
    pii,
    quality,
    resharding,
    secrets,
    toxicity,
    twins,
)
from recloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where SQL can express it, its twin."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(corpus_session(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def corpus_session(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus operators: small Arrow batches, as one row can hold a long text."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, as ``--py-files`` would."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


@query(
    "op8_minhash_near_duplicates",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
      FROM documents),
    s AS (
      SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
          WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
          ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh
        FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (
      SELECT p.a, p.b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
        FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
      JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
      WHERE 100 * p.common >= 75 * (na.n + nb.n - p.common)),
    reach AS (
      SELECT doc_id AS node, doc_id AS seen FROM w
      UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
    FROM w LEFT JOIN n USING (doc_id)
    JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = w.doc_id
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_line_chunk_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.dedup_runs(docs).select("doc_id", "lines_removed", "chars_removed", "text")


@query("op6_mixture_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_linked_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op10_quality_machine")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_contextual_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


@query("op7_permutation_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query("op9_metric_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_equal(table(spark, sf_dir, "embeddings"))


@query("op5_shared_prefix_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents")
    decoded = pieces.decode(pieces.encode(docs)).withColumnRenamed("text", "decoded")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids"
    )


@query("op11_merkle_manifest", twins.manifest())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


@query("op12_flow_resharding", twins.reshard())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.reshard(table(spark, sf_dir, "documents"))


@query("op13_end_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))
