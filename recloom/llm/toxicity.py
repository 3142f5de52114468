"""Toxicity of restored text: disguised words are decoded first, then a linear model over word beginnings scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from recloom.llm import text as tx
from recloom.llm.deobfuscate import Restorer, log_model, trigram_counts
from recloom.llm.labels import fold, training_rows

TRAINING_ROWS = 12_000  # bound of the labelled sample that is fitted
BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)  # bytes; whole words count too
RAREST = 3  # training documents that a feature must occur in
PENALTY = 1e-4


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings of each text: buckets and where each text's start."""
    starts, ends, doc, total = tx.bounds(texts, tx.PUNCTUATION)
    keys, owner = [tx.span_hash(total, starts, ends)], [doc]
    for length in PREFIXES:
        long = ends - starts >= length
        keys.append(tx.span_hash(total, starts[long], starts[long] + length) + np.uint64(length))
        owner.append(doc[long])
    bucket = (tx.mix(np.concatenate(keys)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    pairs = np.unique((np.concatenate(owner) << 18) | bucket)
    return pairs & (BUCKETS - 1), np.searchsorted(pairs, np.arange(len(texts) + 1) << 18)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """Logistic regression over distinct hashed features."""

    weights: np.ndarray
    bias: float

    def score(self, bucket: np.ndarray, edges: np.ndarray) -> np.ndarray:
        summed = np.concatenate(([0.0], np.cumsum(self.weights[bucket], dtype=np.float64)))
        return _sigmoid(summed[edges[1:]] - summed[edges[:-1]] + self.bias)


def fit(bucket: np.ndarray, edges: np.ndarray, y: np.ndarray, steps: int = 1200, rate: float = 0.2) -> Linear:
    """AdaGrad over shuffled minibatches of features scaled by their log-odds; rare features stay out.

    Without rows of both labels the model says everywhere what share is toxic, with one clean row added: nothing
    known about toxicity is no reason to reject.
    """
    if not 0 < y.sum() < len(y):
        share = np.clip(y.sum() / (len(y) + 1), 0.01, 0.99)
        return Linear(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    prior = y.mean()
    owner = np.repeat(y, np.diff(edges))
    seen, toxic = np.bincount(bucket, minlength=BUCKETS), np.bincount(bucket, owner, BUCKETS)
    odds = (toxic + 2 * prior) / (y.sum() + 2) * (len(y) - y.sum() + 2) / (seen - toxic + 2 * (1 - prior))
    scale = np.where(seen >= RAREST, np.log(odds), 0.0)
    model = Linear(np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    squares, bias_square = np.full(BUCKETS, 1e-2), 1e-2
    random = np.random.default_rng(0)
    batches = max(1, len(y) // 64)
    for _ in range(-(-steps // batches)):
        for rows in np.array_split(random.permutation(len(y)), batches):
            sizes = edges[rows + 1] - edges[rows]
            own = np.concatenate([bucket[edges[i] : edges[i + 1]] for i in rows])
            cut = np.concatenate(([0], np.cumsum(sizes)))
            summed = np.concatenate(([0.0], np.cumsum(model.weights[own] * scale[own])))
            error = _sigmoid(summed[cut[1:]] - summed[cut[:-1]] + model.bias) - y[rows]
            used, place = np.unique(own, return_inverse=True)
            slope = np.bincount(place, np.repeat(error, sizes), len(used)) * scale[used] / len(rows)
            slope += PENALTY * model.weights[used]
            squares[used] += slope**2
            model.weights[used] -= rate * slope / np.sqrt(squares[used])
            bias_square += error.mean() ** 2
            model.bias -= rate * error.mean() / np.sqrt(bias_square)
    return Linear((model.weights * scale).astype(np.float32), model.bias)


@dataclass
class ToxicityModel:
    """The character model and the classifier; both of fixed size."""

    characters: np.ndarray
    linear: Linear


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Count characters over all of ``docs``; fit on at most ``rows`` labelled documents outside the held-out fold."""
    characters = log_model(trigram_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(characters)
        for batch in batches:
            texts = tx.column(batch, "text")
            for a, b in tx.chunks(texts):
                bucket, edges = _features(restorer.restore(texts.slice(a, b - a)))
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(bucket.astype(np.int32)))
                y = batch.column(batch.schema.get_field_index("y")).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([y, lists], ["y", "features"])

    sample = training_rows(docs, labels, label, rows).mapInArrow(run, "y double, features array<int>").toArrow()
    lists = sample.column("features").combine_chunks()
    sizes = np.array([len(x) for x in lists], np.int64)
    bucket = lists.flatten().to_numpy().astype(np.int64)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    y = sample.column("y").to_numpy()
    return ToxicityModel(characters, fit(bucket, edges, y))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a last column ``out``, 0 to 1; a column of that name is replaced.

    Null and empty texts get the score of a text without words. Rows stay as they are, repeated ones too.
    """
    docs = docs.drop(out)
    place = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.characters)
        for batch in batches:
            texts = pc.fill_null(batch.column(place).cast(pa.large_string()), "")
            scores = [np.zeros(0)]
            for a, b in tx.chunks(texts):
                scores.append(model.linear.score(*_features(restorer.restore(texts.slice(a, b - a)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names)

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.5).

    Only the text is scored; the id decides the fold. Without usable labels every score is 0.01.
    """
    model = train(docs, labels, rows=rows)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (fold("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
