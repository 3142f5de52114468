"""Cross-tokenizer alignment: the places where tokens of two vocabularies end together.

The cumulative byte ends of both id lists become dictionaries from end to index; the hash sets of their keys are
intersected, and the sorted common ends slice both lists into groups. The pairs of a slice whose byte ranges end
together (its last tokens, as no token is empty) are its links. Both vocabularies begin anew at single spaces, so
this is done once for each distinct word between such spaces, and texts are put together from their words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.llm import text as tx
from recloom.sources.staging import stage

REMEMBERED = 400_000  # words whose alignment a task keeps
HOT_PAIRS = 1_000_000  # id pairs whose counts every task holds (17 bytes each); rarer ones are joined
MERGED = 4_000_000  # pairs counted in a task before equal ones are merged
MARK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONG_SPACE = re.compile(r"\s{20000}")


def default_vocabularies() -> tuple[str, str]:
    """The installed byte-level vocabulary and the installed piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others
    for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bytewise:
    """Byte-level BPE from a ``tokenizers`` file; the strings of special tokens are plain text.

    Where the file's ids are in the order of its merges, they are the ranks that ``tiktoken`` works with, which
    gives the same ids faster; texts with very long runs of white space, which its regular expression cannot take,
    and other files go through ``tokenizers``.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte, vocabulary = _byte_of(), model["vocab"]
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranks = {bytes(byte[c] for c in m): vocabulary[m] for m in merges}
        self.fast = None
        if [vocabulary[m] for m in merges] == list(range(256, 256 + len(merges))):
            ranks |= {bytes([b]): vocabulary[c] for c, b in byte.items()}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(" " + t) for t in texts]

    def _one(self, text: str) -> list[int]:
        if self.fast is None or _LONG_SPACE.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """A piece model; it adds the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.tokens.append(
                bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(MARK, " ").encode()
            )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def _loaded(kind: type, path: str):
    return kind(path)


@dataclass
class Aligned:
    """Some texts as words, and the words' alignments laid end to end.

    ``codes`` and ``of`` are the word and the text of each place. Word ``w`` has tokens ``a[a_at[w] :][: a_n[w]]``, the
    same of B, and slices ``s_at[w] :][: s_n[w]]``, which end at ``a_end`` and ``b_end`` in the word's own tokens.
    """

    texts: int
    codes: np.ndarray
    of: np.ndarray
    words: Words

    def total(self, per_word: np.ndarray) -> np.ndarray:
        """Sums by text."""
        return np.bincount(self.of, per_word[self.codes], self.texts).astype(np.int64)

    def spread(self, at: np.ndarray, n: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The places in a pool of all that the words have there, word after word."""
        reach = np.cumsum(n[codes])
        return np.repeat(at[codes] - (reach - n[codes]), n[codes]) + np.arange(reach[-1] if len(reach) else 0)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair (that of A above that of B, in 64 bits) and number of its links, sorted."""
        w = self.words
        keys, times = np.unique(self.of << 32 | self.codes, return_counts=True)
        codes = keys & 0xFFFFFFFF
        own, pairs = np.repeat(keys >> 32, w.s_n[codes]), w.pair[self.spread(w.s_at, w.s_n, codes)]
        weight = np.repeat(times, w.s_n[codes])
        order = np.lexsort((pairs, own))
        own, pairs, weight = own[order], pairs[order], weight[order]
        new = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (own[1:] != own[:-1])))[: len(own)])
        sums = np.concatenate(([0], np.cumsum(weight)))
        return own[new], pairs[new], sums[np.concatenate((new[1:], [len(own)]))[: len(new)]] - sums[new]


class Words:
    """The alignments of the words met so far; a word is what stands between single spaces.

    Both vocabularies begin anew at such a space, which they put before a word themselves: so the tokens, slices and
    links of a text are those of its words in turn, and a word is tokenized and aligned once.
    """

    def __init__(self, sides: list):
        self.sides = sides
        self.width = [np.array([len(t) for t in side.tokens], np.int64) for side in sides]
        # a decimal id with what follows it: the next id, the other list, the next group
        self.marked = [f"{i}{mark}" for s, marks in zip(sides, (",|", ",;"), strict=True) for mark in marks for i in range(len(s.tokens))]
        self.code: dict[str, int] = {}
        self.told: list[str] = []
        empty = np.zeros(0, np.int64)
        self.a = self.b = self.a_at = self.a_n = self.b_at = self.b_n = empty
        self.s_at = self.s_n = self.a_end = self.b_end = self.pair = empty
        self.lost = np.zeros(0, bool)

    def learn(self, words: list[str]) -> None:
        """Tokenize and align new words, laid end to end."""
        raw = [b" " + w.encode() for w in words]
        lists, lost = [side.encode(words) for side in self.sides], np.zeros(len(words), bool)
        for side, ids in zip(self.sides, lists, strict=True):
            get = side.tokens.__getitem__
            lost |= np.array([b"".join(map(get, x)) != want for x, want in zip(ids, raw, strict=True)], bool)
        # a lost word has no tokens; all others have as many bytes on both sides
        lists = [[[] if bad else x for x, bad in zip(ids, lost.tolist(), strict=True)] for ids in lists]
        sizes = [np.array([len(x) for x in ids], np.int64) for ids in lists]
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in zip(lists, sizes, strict=True))
        ends_a, ends_b = (np.cumsum(w[ids]).tolist() for w, ids in zip(self.width, (a, b), strict=True))
        index_a = dict(zip(ends_a, range(1, len(a) + 1), strict=True))
        index_b = dict(zip(ends_b, range(1, len(b) + 1), strict=True))
        common = sorted(index_a.keys() & index_b.keys())
        a_end = np.fromiter(map(index_a.__getitem__, common), np.int64, len(common))
        b_end = np.fromiter(map(index_b.__getitem__, common), np.int64, len(common))
        a_from, b_from = (np.cumsum(n) - n for n in sizes)
        of = np.searchsorted(np.cumsum(sizes[0]), a_end, "left")
        told = self._tell(a, b, a_end, b_end, sizes)
        self.code.update(zip(words, range(len(self.told), len(self.told) + len(words)), strict=True))
        self.told += told
        slices = np.bincount(of, minlength=len(words))
        for name, at, pool, n in (
            ("a_n", "a_at", self.a, sizes[0]), ("b_n", "b_at", self.b, sizes[1]), ("s_n", "s_at", self.pair, slices)
        ):
            self._add(at, len(pool) + np.cumsum(n) - n)
            self._add(name, n)
        self._add("a", a)
        self._add("b", b)
        self._add("a_end", a_end - a_from[of])
        self._add("b_end", b_end - b_from[of])
        self._add("pair", a[a_end - 1] << 32 | b[b_end - 1])
        self._add("lost", lost)

    def _add(self, name: str, more: np.ndarray) -> None:
        setattr(self, name, np.concatenate((getattr(self, name), more)))

    def _tell(self, a, b, a_end, b_end, sizes) -> list[str]:
        """The groups of each word as text: of every slice the ids of A, then those of B."""
        zero = np.zeros(1, np.int64)
        begin_a, begin_b = (np.concatenate((zero, e))[:-1] for e in (a_end, b_end))
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[a_end - 1] = last_b[b_end - 1] = True
        count, wide = len(self.sides[0].tokens), len(self.sides[1].tokens)
        code = np.zeros(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.repeat(begin_b, a_end - begin_a)] = a + np.where(last_a, count, 0)
        code[np.arange(len(b)) + np.repeat(a_end, b_end - begin_b)] = b + np.where(last_b, wide, 0) + 2 * count
        parts = list(map(self.marked.__getitem__, code.tolist()))
        stops = np.cumsum(sizes[0] + sizes[1]).tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip([0, *stops], stops, strict=False)]


class Aligner:
    """Aligns texts by two vocabularies; neither may have empty tokens."""

    def __init__(self, paths: tuple[str, str]):
        self.sides = [_loaded(Bytewise, paths[0]), _loaded(Pieces, paths[1])]
        for side in self.sides:
            if not all(side.tokens):
                raise ValueError("tokens without bytes cannot be aligned")
        self.words = Words(self.sides)

    def align(self, texts: list[str]) -> Aligned:
        """Texts that are empty, or whose tokens do not give space and text back, have no tokens."""
        cut = [_CUT.split(t) if t else [] for t in texts]
        if len(self.words.told) > REMEMBERED:
            self.words = Words(self.sides)
        new = set().union(*cut).difference(self.words.code)
        if new:
            self.words.learn(sorted(new))
        counts = np.array([len(x) for x in cut], np.int64)
        get = self.words.code.__getitem__
        codes = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        of = np.repeat(np.arange(len(texts)), counts)
        lost = np.zeros(len(texts), bool)
        lost[of[self.words.lost[codes]]] = True
        kept = ~lost[of]
        return Aligned(len(texts), codes[kept], of[kept], self.words)

    def digests(self, found: Aligned) -> list[str]:
        """Per text the sha256 of its groups (``a1,a2|b1;a3|b2,b3``); without tokens the empty string."""
        get, out, at = self.words.told.__getitem__, [], 0
        for stop in np.cumsum(np.bincount(found.of, minlength=found.texts)).tolist():
            told = ";".join(map(get, found.codes[at:stop].tolist()))
            out.append(hashlib.sha256(told.encode()).hexdigest() if told else "")
            at = stop
        return out


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    edges = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values).cast(kind))


def _by_chunk(batches, paths):
    """Rows, their alignment and the aligner for every chunk of a stream of batches."""
    aligner = Aligner(paths)
    for batch in batches:
        texts = tx.column(batch, "text")
        for a, b in tx.chunks(texts):
            yield batch.slice(a, b - a), aligner.align(texts.slice(a, b - a).to_pylist()), aligner


def align(
    docs: DataFrame, vocabularies: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, a_ids, b_ids, a_ends, b_ends (where each group ends in either list).

    A null or empty text, and one that either vocabulary does not give back whole, has no tokens. Rows that repeat
    and null ids are aligned like others; other columns are ignored; an empty table gives an empty result.
    """
    paths = vocabularies or default_vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x, _ in _by_chunk(batches, paths):
            w, lists = x.words, []
            for pool, at, n in ((w.a, w.a_at, w.a_n), (w.b, w.b_at, w.b_n)):
                lists.append((pool[x.spread(at, n, x.codes)], x.total(n)))
            for pool, n in ((w.a_end, w.a_n), (w.b_end, w.b_n)):
                # a slice ends so many tokens after the words before it in its text
                before = np.cumsum(n[x.codes]) - n[x.codes]
                total = x.total(n)
                before -= (np.cumsum(total) - total)[x.of]
                ends = pool[x.spread(w.s_at, w.s_n, x.codes)] + np.repeat(before, w.s_n[x.codes])
                lists.append((ends, x.total(w.s_n)))
            columns = [_lists(v, n, pa.int32()) for v, n in lists]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ints = "array<int>"
    return named.mapInArrow(run, f"doc_id long, a_ids {ints}, b_ids {ints}, a_ends {ints}, b_ends {ints}")


def linked(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(row, doc_id, text) as one row per document: its counts, ``groups_sha256``, and its distinct id pairs with how
    often it links them (``pairs``, ``times``)."""
    paths = vocabularies or default_vocabularies()
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x, aligner in _by_chunk(batches, paths):
            own, pairs, times = x.links()
            distinct = np.bincount(own, minlength=rows.num_rows)
            groups = x.total(x.words.s_n)
            columns = [pa.array(v) for v in (x.total(x.words.a_n), x.total(x.words.b_n), groups, groups, aligner.digests(x))]
            columns += [_lists(pairs, distinct, pa.int64()), _lists(times, distinct, pa.int32())]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], names)

    longs = ", ".join(f"{n} long" for n in names[:6])
    return docs.select("row", "doc_id", "text").mapInArrow(
        run, f"{longs}, groups_sha256 string, pairs array<long>, times array<int>"
    )


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of all links in ``linked`` rows: how many there are, and whether no pair with the same id of B
    has more. Counted in the tasks first, so a pair that stands everywhere is not shuffled link by link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            every = np.concatenate([held, *(p for p, _ in parts)])
            keys, at = np.unique(every, return_inverse=True)
            return keys, np.bincount(at, np.concatenate([counts, *(n for _, n in parts)]), len(keys)).astype(np.int64)

        for batch in batches:
            parts.append((batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()))
            waiting += len(parts[-1][0])
            if waiting > MERGED:
                held, counts = merged()
                parts, waiting = [], 0
                if len(held) > MERGED:
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "n"])
                    held, counts = held[:0], counts[:0]
        held, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "n"])

    some = rows.select("pairs", "times").mapInArrow(run, "pair long, n long")
    counts = stage(some.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, hot: int = HOT_PAIRS) -> DataFrame:
    """``linked`` rows with ``n_best`` and ``count_sum``.

    The commonest ``hot`` pairs are looked up in the tasks; links of rarer ones, few by then, are joined.
    """
    top = counts.orderBy(F.desc("n"), "pair").limit(hot).toArrow().sort_by("pair")  # at most ``hot`` rows
    table = [top.column(c).to_numpy() for c in ("pair", "n", "best")]
    shared = rows.sparkSession.sparkContext.broadcast(table)
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            lists = batch.column(len(kept))
            sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            pairs, times = lists.flatten().to_numpy(), batch.column(len(kept) + 1).flatten().to_numpy()
            own = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            total, good = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(total, own[known], times[known] * n[at[known]])
            np.add.at(good, own[known], times[known] * best[at[known]])
            rest = np.bincount(own[~known], minlength=len(sizes))
            columns = [pa.array(good), pa.array(total)]
            columns += [_lists(pairs[~known], rest, pa.int64()), _lists(times[~known], rest, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *columns], [*kept, "n_best", "count_sum", "pairs", "times"]
            )

    longs = ", ".join(f"{c} long" for c in kept[:-1])
    found = rows.select(*kept, "pairs", "times").mapInArrow(
        run, f"{longs}, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<int>"
    )
    found = stage(found, "scored")
    cold = found.filter("size(pairs) > 0").select("row", F.inline(F.arrays_zip("pairs", "times")))
    cold = cold.join(counts, cold["pairs"] == counts["pair"]).groupBy("row")
    more = cold.agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_sum"),
    )
    joined = found.join(more, "row", "left")
    return joined.select(
        *kept[1:6],
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def alignment(docs: DataFrame, vocabularies: tuple[str, str] | None = None, hot: int = HOT_PAIRS) -> DataFrame:
    """Digest of the alignment of every document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256.

    Texts as in ``align``: those without tokens have zeros and an empty digest. However long a text is, it is aligned
    word by word; only a run without any single space between other characters is tokenized in one go. Rows that repeat count as links of their own;
    null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    named = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    rows = stage(linked(named, vocabularies), "linked")
    return scored(rows, stage(pair_counts(rows), "pair-ranks"), hot)
