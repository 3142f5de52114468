"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

``y = b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``: pairs of features interact at a
cost linear in their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.llm import text as tx
from recloom.llm.labels import fold, training_rows

TRAINING_ROWS = 12_000  # bound of the labelled sample that is fitted
BUCKETS = 1 << 16  # of hashed words
FACTORS = 8
STATISTICS = 14
BINS = 8  # each statistic is one of so many levels
RAREST = 3
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 letter, 2 digit, 3 sentence mark, 4 other symbol
_KIND[33:127] = 4
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[[ord(c) for c in ".,;:!?'\"-"]] = 3
# Upper ends of the levels of shares, and of sizes on a log scale.
_SHARES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
_SIZES = np.array([2.0, 3.5, 4.5, 5.5, 6.5, 7.5, 9.0])


def _statistics(texts: pa.Array, n_chars: np.ndarray, starts, ends, doc, hashes) -> np.ndarray:
    """Levels of the structure statistics and the declared length, one row per text."""
    raw, at = tx.flat(texts)
    n = len(texts)
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[at])
    size = np.maximum(np.diff(at), 1)
    kind = _KIND[raw]
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    same_doc = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    again = same_doc & (hashes[1:] == hashes[:-1]) if len(doc) else same_doc
    pairs = np.unique(np.stack((doc.astype(np.uint64), hashes)), axis=1)[0] if len(doc) else np.zeros(0, np.uint64)
    distinct = np.bincount(pairs.astype(np.int64), minlength=n)
    tail = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    lines = sums(raw == 10) + 1
    length = (ends - starts).astype(np.float64)
    shares = [
        sums(kind == 4) / size,
        sums(kind == 3) / size,
        sums(kind == 2) / size,
        sums((raw >= 65) & (raw <= 90)) / size,
        np.bincount(doc[1:][again], minlength=n) / some if len(doc) else np.zeros(n),
        1 - distinct / some,
        np.bincount(doc, _KIND[tail] == 4, n) / some if len(doc) else np.zeros(n),
        np.bincount(doc, length == 1, n) / some if len(doc) else np.zeros(n),
        lines / some,
    ]
    sizes = [
        np.log1p(words),
        np.log1p(lines),
        np.log1p(np.nan_to_num(n_chars)),
        np.bincount(doc, length, n) / some / 1.5 if len(doc) else np.zeros(n),
        np.log1p(words / lines),
    ]
    levels = [np.searchsorted(_SHARES, x, "right") for x in shares] + [np.searchsorted(_SIZES, x, "right") for x in sizes]
    return np.stack(levels, axis=1)


def features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their values and where each text's start: words share one unit of length."""
    starts, ends, doc, hashes = tx.words(texts)
    bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    pairs, times = np.unique(doc.astype(np.int64) << 20 | bucket, return_counts=True)
    owner, word = pairs >> 20, pairs & (1 << 20) - 1
    weight = np.log1p(times)
    norm = np.sqrt(np.bincount(owner, weight**2, len(texts)))
    levels = _statistics(texts, n_chars, starts, ends, doc, hashes)
    number = BUCKETS + np.arange(STATISTICS) * BINS + levels
    owners = np.concatenate((owner, np.repeat(np.arange(len(texts)), STATISTICS)))
    order = np.argsort(owners, kind="stable")
    every = np.concatenate((word, number.ravel()))[order]
    value = np.concatenate((weight / norm[owner], np.full(number.size, 0.5)))[order]
    return every, value, np.searchsorted(owners[order], np.arange(len(texts) + 1))


def _rows_sum(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    summed = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return summed[edges[1:]] - summed[edges[:-1]]


@dataclass
class FactorisationMachine:
    """Weights of fixed size: one per feature, and ``FACTORS`` of them for its interactions."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, number: np.ndarray, value: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of every row, and its factor sums."""
        v = self.factors[number] * value[:, None]
        total = _rows_sum(v, edges)
        pairs = 0.5 * (total**2 - _rows_sum(v**2, edges)).sum(1)
        return self.bias + _rows_sum(self.weights[number] * value, edges) + pairs, total

    def score(self, number: np.ndarray, value: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(number, value, edges)[0], -30, 30)))


def fit(number, value, edges, y, steps: int = 1200, rate: float = 0.1, penalty: float = 1e-4) -> FactorisationMachine:
    """AdaGrad over shuffled minibatches; words in few rows stay out. Without rows of both labels: 0.5 everywhere."""
    width = BUCKETS + STATISTICS * BINS
    random = np.random.default_rng(0)
    if not 0 < y.sum() < len(y):
        return FactorisationMachine(0.0, np.zeros(width), np.zeros((width, FACTORS)))
    used = np.bincount(number, minlength=width) >= RAREST
    prior = y.mean()
    start = random.normal(0, 0.02, (width, FACTORS)) * used[:, None]
    model = FactorisationMachine(float(np.log(prior / (1 - prior))), np.zeros(width), start)
    seen_w, seen_v, seen_b = np.full(width, 1e-2), np.full((width, FACTORS), 1e-2), 1e-2
    batches = max(1, len(y) // 64)
    for _ in range(-(-steps // batches)):
        for rows in np.array_split(random.permutation(len(y)), batches):
            sizes = edges[rows + 1] - edges[rows]
            cut = np.concatenate(([0], np.cumsum(sizes)))
            at = np.repeat(edges[rows] - cut[:-1], sizes) + np.arange(cut[-1])
            x, n = value[at], number[at]
            margin, total = model.margin(n, x, cut)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            each = np.repeat(error, sizes) * x
            ids, place = np.unique(n, return_inverse=True)
            keep = used[ids]
            slope = (np.bincount(place, each, len(ids)) + penalty * model.weights[ids]) * keep
            own = each[:, None] * (np.repeat(total, sizes, axis=0) - model.factors[n] * x[:, None])
            slope_v = np.stack([np.bincount(place, own[:, f], len(ids)) for f in range(FACTORS)], axis=1)
            slope_v = (slope_v + penalty * model.factors[ids]) * keep[:, None]
            seen_w[ids] += slope**2
            seen_v[ids] += slope_v**2
            seen_b += error.sum() ** 2
            model.weights[ids] -= rate * slope / np.sqrt(seen_w[ids])
            model.factors[ids] -= rate * slope_v / np.sqrt(seen_v[ids])
            model.bias -= rate * error.sum() / np.sqrt(seen_b)
    return model


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    texts = tx.column(batch, "text")
    n_chars = batch.column(batch.schema.get_field_index("n_chars")).to_numpy(zero_copy_only=False)
    for a, b in tx.chunks(texts):
        yield a, b, texts.slice(a, b - a), np.nan_to_num(n_chars[a:b].astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> FactorisationMachine:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts, n_chars in _parts(batch):
                number, value, edges = features(texts, n_chars)
                offsets = pa.array(edges.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(batch.schema.get_field_index("y")).slice(a, b - a),
                        pa.ListArray.from_arrays(offsets, pa.array(number.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32))),
                    ],
                    ["y", "number", "value"],
                )

    schema = "y double, number array<int>, value array<float>"
    sample = training_rows(docs, labels, label, rows).mapInArrow(run, schema).toArrow()
    lists = sample.column("number").combine_chunks()
    edges = lists.offsets.to_numpy().astype(np.int64)
    number = lists.flatten().to_numpy().astype(np.int64)
    value = sample.column("value").combine_chunks().flatten().to_numpy().astype(np.float64)
    return fit(number, value, edges - edges[0], sample.column("y").to_numpy())


def quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.3).

    Inputs of the score are the text and the declared length (``n_chars``, the text's own where that column
    is absent). Null and empty texts score by their structure alone. Without usable labels every score is
    0.5. Repeated rows are scored alike; an empty table gives an empty result.
    """
    model = train(docs, labels, rows=rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts, n_chars in _parts(batch):
                scores = pa.array(model.score(*features(texts, n_chars)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), scores], ["doc_id", "score"])

    size = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    named = docs.select(F.col("doc_id").cast("long"), "text", size.cast("double").alias("n_chars"))
    scored = named.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (fold("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
