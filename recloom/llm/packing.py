"""Mixture-controlled packing: deficit round-robin over one queue per source, as a closed form.

Every window gives each source its share of tokens; what rounding leaves over is owed to the next windows.
Serving tokens in the order of the virtual time at which a source's credit reaches the middle of each token
is that round-robin, so the allotment of any window follows from its number alone and every partition cuts
its own documents. A source that runs out gives its share to the others, in proportion.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recloom.llm import text as tx
from recloom.llm.staging import stage_rows
from recloom.session import scratch_path

SEQUENCE = 2048
MAX_QUEUES = 1024  # the largest sources have a queue each, all others share one
REMEMBERED_WORDS = 600_000
FRESH_WORDS = 60_000  # learnt words that are sorted apart, so that the many known ones are not moved for each batch
BROADCAST_ROWS = 100_000  # of 20 bytes; a longer table of offsets is joined by a shuffle


def default_tokenizer() -> str:
    """The installed word-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass
class _Places:
    """Where the ids of words lie in a pool, by sorted word key; the first one has no word."""

    keys: np.ndarray
    at: np.ndarray
    size: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place for each key, and whether it is that of the key."""
        place = np.searchsorted(self.keys[:-1], keys)
        return place, self.keys[place] == keys

    def joined(self, other: _Places) -> _Places:
        every = np.concatenate((self.keys, other.keys))
        order = np.argsort(every, kind="stable")
        return _Places(
            every[order], np.concatenate((self.at, other.at))[order], np.concatenate((self.size, other.size))[order]
        )


class WordEncoder:
    """Token ids of texts, word by word: white space is dropped by the tokenizer, so words encode alone.

    Words are lower-cased (A-Z; the tokenizer does so too) and known by a 64-bit hash and their length; the ids
    of known words lie in one pool. New words of letters are encoded many at a time: each ends with an id that
    carries the mark of a word's end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.quick = _quick_letters(path, vocabulary)
        self._forget()

    def _forget(self) -> None:
        # one key to begin with, so that there is always a next one to look at
        self.pool = np.zeros(0, self.kind)
        self.known = _Places(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64))
        self.fresh = self.known  # words learnt lately, put to the others now and then

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end`` after each text, and how many each text has."""
        starts, ends, doc, hashes = tx.words(texts)
        codes, distinct = pd.factorize(tx.mix(hashes ^ (ends - starts).astype(np.uint64)))
        if len(self.known.keys) + len(distinct) > REMEMBERED_WORDS:
            self._forget()
        place, known = self.known.find(distinct)
        late, lately = self.fresh.find(distinct)
        at = np.where(known, self.known.at[place], self.fresh.at[late])
        size = np.where(known, self.known.size[place], self.fresh.size[late])
        new = np.flatnonzero(~(known | lately))
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw = tx.LOWER[tx.flat(texts)[0]].tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            at[new], size[new] = self._learn(distinct[new], [raw[a:b] for a, b in spans])
        at, size = at[codes], size[codes]
        reach = np.cumsum(size)
        ids = self.pool[np.repeat(at - (reach - size), size) + np.arange(reach[-1] if len(reach) else 0)]
        counts = np.bincount(doc, size, len(texts)).astype(np.int64) + 1
        out = np.full(len(ids) + len(texts), end, self.kind)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts) - 1] = False
        out[inner] = ids
        return out, counts

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Add new words and say where they lie; sentence marks behind letters are tokens of their own."""
        coded: dict[bytes, bytes] = {}
        stems, marks = list(words), [b""] * len(words)
        for i, word in enumerate(words):
            if word[-1] in _MARKS:
                stem = word.rstrip(_MARKS)
                if stem and (97 <= stem[-1] <= 122 or stem.decode()[-1].isalpha()):
                    stems[i], marks[i] = stem, word[len(stem) :]
        wanted = {*stems, *marks} - {b""}
        plain = [w for w in wanted if w.isalpha()] if self.quick else []  # of bytes: a to z alone
        wanted.difference_update(plain)
        if plain:
            turned = b"".join([w[:-1] + w[-1:].upper() for w in plain]).decode()
            self._cut(plain, np.array(self.quick.encode_ordinary(turned), self.kind), coded)
        letters = [w for w in wanted if w.decode().isalpha()]
        for k in range(0, len(letters), 2_000):
            self._code_letters(letters[k : k + 2_000], coded)
        self._code(list(wanted.difference(letters)), coded)
        coded[b""] = b""
        parts = [coded[s] + coded[m] for s, m in zip(stems, marks, strict=True)]
        size = np.array([len(x) for x in parts], np.int64) // self.kind.itemsize
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate((self.pool, np.frombuffer(b"".join(parts), self.kind)))
        self.fresh = self.fresh.joined(_Places(keys, at, size))
        if len(self.fresh.keys) > FRESH_WORDS:
            self.known = self.known.joined(self.fresh)
            self.fresh = _Places(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64))
        return at, size

    def _code(self, words: list[bytes], coded: dict[bytes, bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        coded.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(words, found, strict=True))

    def _code_letters(self, words: list[bytes], coded: dict[bytes, bytes]) -> None:
        joined = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0]
        ids = np.array(joined.ids, self.kind)
        if np.count_nonzero(self.closes[ids]) != len(words):  # a vocabulary without such marks
            return self._code(words, coded)
        self._cut(words, ids, coded)

    def _cut(self, words: list[bytes], ids: np.ndarray, coded: dict[bytes, bytes]) -> None:
        """The ids of words laid end to end, each of which ends with a marked one."""
        stops = (np.flatnonzero(self.closes[ids]) + 1) * self.kind.itemsize
        data, edges = ids.tobytes(), [0, *stops.tolist()]
        coded.update((w, data[a:b]) for w, a, b in zip(words, edges[:-1], edges[1:], strict=True))


def _quick_letters(path: str, vocabulary: Mapping[str, int]):
    """A faster encoder for words of a to z, with the same ids; None where the file does not allow it.

    A capital stands for a letter with the mark of a word's end, so words can be laid end to end. Ids in the order
    of the merges are the ranks that ``tiktoken`` works with.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    ids = [vocabulary.get(m) for m in merges]
    if None in ids or any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        return None
    import tiktoken

    ranks = {}
    for token, i in vocabulary.items():
        stem = token.removesuffix("</w>")
        if re.fullmatch("[a-z]+", stem):
            ranks[(stem if stem == token else stem[:-1] + stem[-1].upper()).encode()] = i
    if not all(bytes([c]) in ranks for c in (*range(65, 91), *range(97, 123))):
        return None
    return tiktoken.Encoding("letters", pat_str="[a-z]*[A-Z]", mergeable_ranks=ranks, special_tokens={})


_MARKS = b".,;:!?"
_ENCODERS: dict[str, WordEncoder] = {}


def tokenize(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, queue, text) as (doc_id, queue, part, before, n, ids): packed ids and, within the partition and
    queue, the tokens before. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        encoder, part, so_far = _ENCODERS[path], TaskContext.get().partitionId(), {}
        for batch in batches:
            texts = tx.column(batch, "text")
            for a, b in tx.chunks(texts):
                ids, n = encoder.encode(texts.slice(a, b - a), end)
                queues, before = batch.column(1).slice(a, b - a).to_pylist(), []
                for q, k in zip(queues, n.tolist(), strict=True):
                    before.append(so_far.get(q, 0))
                    so_far[q] = before[-1] + k
                edges = np.concatenate(([0], np.cumsum(n))) * ids.itemsize
                packed = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(n), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(queues, pa.int32()),
                        pa.array([part] * len(n), pa.int32()),
                        pa.array(before, pa.int64()),
                        pa.array(n),
                        packed.cast(pa.binary()),
                    ],
                    ["doc_id", "queue", "part", "before", "n", "ids"],
                )

    schema = "doc_id long, queue int, part int, before long, n long, ids binary"
    return docs.select("doc_id", "queue", "text").mapInArrow(run, schema)


@dataclass
class Mixture:
    """How far each queue has been served after any number of tokens."""

    totals: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self.totals = np.asarray(self.totals, np.float64)
        left, w = self.totals.copy(), np.where(self.totals > 0, np.asarray(self.weights, np.float64), 0.0)
        clock, served = [0.0], [np.zeros(len(left))]
        while (open_ := left > 0).any():
            rate = np.where(open_, np.maximum(w, 1e-12), 0.0)
            rate /= rate.sum()
            span = np.where(open_, left / np.maximum(rate, 1e-300), np.inf)
            step = span.min()
            left = np.where(span <= step * (1 + 1e-9), 0.0, left - rate * step)
            clock.append(clock[-1] + step)
            served.append(self.totals - left)
        clock[-1] = self.totals.sum()
        self.clock, self.served = np.array(clock), np.array(served)

    def _credit(self, t: float) -> np.ndarray:
        k = min(max(int(np.searchsorted(self.clock, t, "right")) - 1, 0), max(len(self.clock) - 2, 0))
        if len(self.clock) == 1:
            return self.served[0]
        share = (min(max(t, 0.0), self.clock[-1]) - self.clock[k]) / (self.clock[k + 1] - self.clock[k])
        return self.served[k] + share * (self.served[k + 1] - self.served[k])

    def _when(self, queue: int, places: np.ndarray) -> np.ndarray:
        return np.interp(places, self.served[:, queue], self.clock)

    def allotted(self, tokens: int) -> np.ndarray:
        """Tokens of each queue among the first ``tokens`` served; they sum to it and never fall."""
        slack = len(self.totals) / 2 + 1
        low = np.floor(self._credit(tokens - slack) + 0.5).astype(np.int64)
        high = np.maximum(np.floor(self._credit(tokens + slack) + 0.5).astype(np.int64), low)
        queue = np.repeat(np.arange(len(low)), high - low)
        place = np.arange(len(queue)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[queue]
        if len(self.clock) == 2:  # natural proportions: one straight line each
            due = (place + 0.5) * (self.clock[1] / self.totals[queue])
        else:
            due = np.array([self._when(q, p + 0.5) for q, p in zip(queue, place, strict=True)])
        chosen = np.lexsort((queue, due))[: tokens - int(low.sum())]
        return low + np.bincount(queue[chosen], minlength=len(low))

    def first_window(self, queue: int, place: int, window: int) -> int:
        """A window that starts at or before the one with token ``place`` of a queue."""
        return max(int((self._when(queue, np.array([place]))[0] - len(self.totals) - 2) // window), 0)


class Cutter:
    """Cuts documents into pieces; remembers the allotments of a bounded number of windows."""

    def __init__(self, mixture: Mixture, window: int):
        self.mixture, self.window = mixture, window
        self.total = int(mixture.totals.sum())
        self.known: dict[int, np.ndarray] = {}

    def allotted(self, w: int) -> np.ndarray:
        if w not in self.known:
            if len(self.known) * len(self.mixture.totals) > 4_000_000:
                self.known.clear()
            self.known[w] = self.mixture.allotted(min(w * self.window, self.total))
        return self.known[w]

    def cut(self, queue: int, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Documents of one queue at ``starts``: for each piece its document, start there, length, place overall."""
        w, last = self.mixture.first_window(queue, int(starts.min()), self.window), int((starts + n).max())
        while w and self.allotted(w)[queue] > starts.min():
            w -= 1
        first, edges, ahead = w, [], []
        while not edges or edges[-1] < last:
            before, after = self.allotted(w), self.allotted(w + 1)
            # where in all tokens the window's part of this queue begins
            ahead.append(w * self.window + int((after - before)[:queue].sum()) - int(before[queue]))
            edges.append(int(after[queue]))
            w += 1
        opens = np.array([int(self.allotted(first)[queue]), *edges[:-1]], np.int64)
        shift = np.array(ahead, np.int64)
        # cut at the windows, then at the sequences inside each
        lo, hi = np.searchsorted(opens, starts, "right"), np.searchsorted(opens, starts + n, "left")
        doc, at, stop = _split(np.arange(len(n)), starts, starts + n, lo, hi, opens)
        shift = shift[np.searchsorted(opens, at, "right") - 1]
        doc_at, place, size = np.arange(len(at)), at + shift, stop - at
        marks = np.arange(place.min() // SEQUENCE, (place + size).max() // SEQUENCE + 2) * SEQUENCE
        lo, hi = np.searchsorted(marks, place, "right"), np.searchsorted(marks, place + size, "left")
        piece, begin, end = _split(doc_at, place, place + size, lo, hi, marks)
        own = doc[piece]
        return own, begin - shift[piece] - starts[own], end - begin, begin


def _split(ids, start, stop, lo, hi, marks):
    """Intervals cut at the marks number lo..hi-1 of each."""
    count = hi - lo + 1
    first = np.cumsum(count) - count
    own = np.repeat(np.arange(len(ids)), count)
    inside = np.arange(len(own)) - first[own]
    begin = np.where(inside == 0, start[own], marks[np.minimum(lo[own] + inside - 1, len(marks) - 1)])
    end = np.where(inside == count[own] - 1, stop[own], marks[np.minimum(lo[own] + inside, len(marks) - 1)])
    return ids[own], begin, end


def _stage(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokenizer: str | None = None,
    end: int = 1,
    window: int = SEQUENCE,
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_queue.

    ``window`` (a multiple of 2048) tokens hold the target proportions: by default those of the corpus, else
    ``weights`` by source (a source not named counts 0 and is served last). Only the last sequence is short.
    A null text is one token, the end id. A null source is the empty one; null ids and repeated rows are packed
    like others. An empty table gives no piece; other columns are ignored.
    """
    if window % SEQUENCE:
        raise ValueError("window must be a multiple of 2048")
    path = tokenizer or default_tokenizer()
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(text_col).alias("text"),
    )
    largest = named.groupBy("source").count().orderBy(F.desc("count"), "source").limit(MAX_QUEUES - 1)
    sources = [r["source"] for r in largest.collect()]  # at most MAX_QUEUES - 1 names
    if not sources:
        schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        return docs.sparkSession.createDataFrame([], schema + ", source_queue int")
    number = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(sources) for x in (s, i)]), F.col("source")),
        F.lit(len(sources)),
    )
    coded = _stage(tokenize(named.withColumn("queue", number), path, end), "token-ids")

    parts = coded.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("queue", "part", "tokens", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))
    bases = stage_rows(bases, "queue-offsets", (len(sources) + 1) * len(coded.inputFiles()))
    totals = np.zeros(len(sources) + 1)
    for queue, tokens in bases.groupBy("queue").agg(F.sum("tokens")).collect():  # a row per queue
        totals[queue] = tokens
    shares = totals if weights is None else np.array([*(weights.get(s, 0.0) for s in sources), 0.0])
    mixture = Mixture(totals, shares)

    from_vocabulary = WordEncoder(path).kind

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(mixture, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield from _pieces(batch.slice(at, 500), cutter, from_vocabulary)

    offsets = bases.select("queue", "part", "base")
    if bases.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = coded.join(offsets, ["queue", "part"]).select(
        "doc_id", "queue", "part", (F.col("base") + F.col("before")).alias("at"), "n", "ids"
    )
    return placed.mapInArrow(
        cut,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
        " source_queue int",
    )


def _pieces(batch: pa.RecordBatch, cutter: Cutter, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    queue, part, at, n = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
    ids = batch.column(5)
    group = queue.astype(np.int64) << 32 | part
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        own, start, length, place = cutter.cut(int(g >> 32), at[rows], n[rows])
        wide = [np.frombuffer(ids[int(i)].as_buffer(), kind).astype("<u4") for i in rows]
        sums = [
            zlib.crc32(wide[i][a : a + k]) for i, a, k in zip(own.tolist(), start.tolist(), length.tolist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows[own])),
                pa.array(start),
                pa.array(length),
                pa.array(sums, pa.int64()),
                pa.array(n[rows[own]]),
                pa.array(place // SEQUENCE),
                pa.array(place % SEQUENCE),
                pa.array(np.full(len(own), g >> 32, np.int32)),
            ],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source_queue"],
        )
