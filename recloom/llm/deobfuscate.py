"""Noisy-channel restoration of disguised words: a character lattice decoded under a character trigram model.

A disguised token is read as letters sent through a channel that swaps look-alikes (``l0ser``), separates
letters (``i d i o t``, ``s.t.u.p.i.d``), masks them (``st*pid``) or repeats them (``idiooot``). Each place of
the token has a few letters it may stand for; Viterbi picks the likeliest text. A token is decoded if it has a
letter and any place with a choice: a look-alike, a doubled letter of Latin-1 or a separator between letters. So are
three or more single letters or look-alikes, one of them a letter, with only separators between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.llm import text as tx

# Symbols: 0 is a word boundary, 1-26 a-z, 27-59 the letters of Latin-1, 60 any other letter.
SYMBOLS, OTHER = 64, 60
_SYMBOL = np.zeros(0x250, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_LATIN = [c for c in range(0xDF, 0x100) if c != 0xF7]
for _i, _c in enumerate(_LATIN):
    _SYMBOL[_c] = 27 + _i
    if _c not in (0xDF, 0xFF):
        _SYMBOL[_c - 32] = 27 + _i
_SYMBOL[0x100:] = OTHER
_CHARS = {0: " "} | {i + 1: chr(97 + i) for i in range(26)} | {27 + i: chr(c) for i, c in enumerate(_LATIN)}

# What each look-alike may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou",
}
SEPARATORS = " ._-~'"
# Log-probabilities of the channel's acts.
SWAP, DROP, KEEP_GAP, DOUBLE = -1.0, -0.5, -2.0, -0.7

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LOOKALIKES]] = True
# What stands for one letter: marks may also surround it, as in "t!".
_ONE = np.zeros(256, bool)
_ONE[97:123] = _ONE[48:58] = True
_ONE[[0xC3, ord("@"), ord("$")]] = True
_SEP = np.zeros(256, bool)
_SEP[[ord(c) for c in SEPARATORS]] = True


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n) over all texts: how often each three symbols follow each other; at most 64^3 rows.

    Null and empty texts add nothing. Runs of boundaries count as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            texts = tx.column(batch, "text")
            for a, b in tx.chunks(texts):
                joined = "\n".join(texts.slice(a, b - a).to_pylist())
                points = np.frombuffer(("\n\n" + joined + "\n").encode("utf-32-le"), np.uint32)
                s = _SYMBOL[np.minimum(points, len(_SYMBOL) - 1)].astype(np.int32)
                s = s[np.concatenate(([True], (s[1:] > 0) | (s[:-1] > 0)))]
                total += np.bincount((s[:-2] << 12) + (s[1:-1] << 6) + s[2:], minlength=SYMBOLS**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "code long, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def log_model(counts: DataFrame) -> np.ndarray:
    """The trigram model as a 64 x 64 x 64 table of log-probabilities, smoothed by its bigrams and letters."""
    n = np.zeros(SYMBOLS**3)
    for code, seen in counts.collect():  # at most 64^3 rows
        n[code] = seen
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = n.sum((0, 1)) + 0.1
    one /= one.sum()
    two = n.sum(0) + 2 * one
    two /= two.sum(1, keepdims=True)
    three = n + 2 * two
    return np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


def _places(token: str) -> list[tuple[str, list[tuple[int | None, float]]]]:
    """The lattice: per place its character, and (symbol or None for nothing, log-probability) of each alternative."""
    out, before, run = [], "", 0
    for i, c in enumerate(token):
        run = run + 1 if c == before else 1
        before = c
        letter = int(_SYMBOL[min(ord(c), len(_SYMBOL) - 1)])
        if letter:
            if run == 1:
                out.append((c, [(letter, 0.0)]))
            elif run == 2:  # a double letter, or one said twice
                out.append((c, [(letter, DOUBLE), (None, DOUBLE)]))
        elif c in LOOKALIKES:
            may = [(ord(x) - 96, SWAP) for x in LOOKALIKES[c]]
            if run > 1 or i in (0, len(token) - 1):
                may.append((None, DROP))
            if run < 3:
                out.append((c, may + [(0, KEEP_GAP)] * (c in "!|+(*#")))
        elif c in SEPARATORS:
            if run == 1:
                out.append((c, [(None, DROP), (0, KEEP_GAP)]))
        else:
            out.append((c, [(0, 0.0)]))
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest text behind one token. Ties go to the earlier alternative of each place."""
    best = {(0, 0): (0.0, None)}
    for c, place in _places(token):
        step: dict = {}
        for (p, q), (score, path) in best.items():
            row = model[p, q]
            for symbol, cost in place:
                if symbol is None:
                    key, total, back = (p, q), score + cost, path
                elif symbol == 0 and q == 0:
                    key, total, back = (p, q), score + cost, path
                else:
                    key, total, back = (q, symbol), score + cost + float(row[symbol]), (_CHARS.get(symbol, c), path)
                if key not in step or total > step[key][0]:
                    step[key] = (total, back)
        best = step
    _, path = max(
        ((s + (0.0 if q == 0 else float(model[p, q, 0])), path) for (p, q), (s, path) in best.items()),
        key=lambda x: x[0],
    )
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).strip()


def _suspects(raw: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted (start, end) of what is to be decoded: tokens whose lattice has a choice, and runs of spaced letters."""
    n = len(raw)
    letter, leet, gap = _LETTER[raw], _LEET[raw], _SEP[raw]
    core = np.concatenate(([0], np.cumsum(letter | leet)))
    choice = leet.copy()
    choice[1:] |= letter[1:] & (raw[1:] < 128) & (raw[1:] == raw[:-1])
    choice[3:] |= (raw[2:-1] == 0xC3) & (raw[:-3] == 0xC3) & (raw[3:] == raw[1:-2])
    places = np.flatnonzero(gap & (raw != 32))
    token = np.searchsorted(starts, places, "right") - 1
    between = (core[places] > core[starts[token]]) & (core[ends[token]] > core[places + 1])
    choice[places[between]] = True
    count = lambda x: (lambda sums: sums[ends] - sums[starts])(np.concatenate(([0], np.cumsum(x))))
    chosen = np.flatnonzero((count(choice) > 0) & (count(letter) > 0))
    spans = np.stack((starts[chosen], ends[chosen]), 1)

    # words of letters and look-alikes that stand for one letter each
    inside = letter | leet
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    opens = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    closes = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    sums = lambda x: np.concatenate(([0], np.cumsum(x)))
    ones, follows, gaps = sums(_ONE[raw]), sums((raw & 0xC0) == 0x80), sums(gap)
    lead = sums((raw >= 0x80) & ((raw & 0xC0) != 0x80) & (raw != 0xC3))
    number = ones[closes] - ones[opens]
    length = closes - opens - (follows[closes] - follows[opens])
    single = (lead[closes] == lead[opens]) & ((number == 1) | (number == 0) & (length == 1))
    linked = single[1:] & single[:-1] & (gaps[opens[1:]] - gaps[closes[:-1]] == opens[1:] - closes[:-1])
    linked &= sums(edge)[opens[1:] + 1] == sums(edge)[closes[:-1]]  # in one text
    head = np.flatnonzero(single & ~np.concatenate(([False], linked))[: len(single)])
    tail = np.flatnonzero(single & ~np.concatenate((linked, [False]))[: len(single)])
    letters = sums(letter)
    enough = (tail - head >= 2) & (letters[closes[tail]] > letters[opens[head]])
    spaced = np.stack((opens[head[enough]], closes[tail[enough]]), 1)
    spans = np.concatenate((spans, spaced))
    return spans[np.lexsort((spans[:, 1], spans[:, 0]))]


class Restorer:
    """Restores texts under a model; remembers what it decoded, up to a bound."""

    def __init__(self, model: np.ndarray, remember: int = 200_000):
        self.model, self.remember, self.known = model, remember, {}

    def word(self, token: bytes) -> bytes:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            found = self.known[token] = decode(token.decode("utf-8", "replace"), self.model).encode()
        return found

    def restore(self, texts: pa.Array) -> pa.Array:
        """The texts with every disguised token replaced; a text without any is passed on as it is."""
        raw, at = tx.flat(texts)
        raw = tx.LOWER[raw]
        starts, ends, _, _ = tx.words(texts)
        spans = _suspects(raw, at, starts, ends) if len(starts) else np.zeros((0, 2), np.int64)
        if not len(spans):
            return texts
        # overlapping spans are one
        reach = np.maximum.accumulate(spans[:, 1])
        opens = np.flatnonzero(np.concatenate(([True], spans[1:, 0] >= reach[:-1])))
        closes = reach[np.concatenate((opens[1:], [len(spans)])) - 1]
        data, changed = raw.tobytes(), []
        for a, b in zip(spans[opens, 0].tolist(), closes.tolist(), strict=True):
            token = data[a:b]
            meant = self.word(token)
            if meant != token:
                changed.append((a, b, meant))
        pieces, k = [], 0
        for i in range(len(texts)):
            end, parts, where = int(at[i + 1]), [], int(at[i])
            while k < len(changed) and changed[k][0] < end:
                a, b, meant = changed[k]
                parts += [data[where:a], meant]
                where, k = b, k + 1
            parts.append(data[where:end])
            pieces.append(b"".join(parts))
        return pa.array(pieces, pa.large_binary()).cast(pa.large_string())
