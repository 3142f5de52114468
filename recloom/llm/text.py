"""Arrow text columns as flat byte arrays: words, word hashes and shingle sets without per-word Python.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; only A-Z are lower-cased. A null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
EXACT = np.arange(256, dtype=np.uint8)
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
# For words of letters, digits and anything beyond ASCII.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[48:58] = PUNCTUATION[65:91] = PUNCTUATION[97:123] = PUNCTUATION[128:] = False
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for i up to at least ``n``; kept between batches."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with 64-bit offsets, null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts (one more entry than texts)."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHUNK_BYTES`` each; a longer text is a range of its own."""
    if len(texts) == 0:
        return
    _, at = flat(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(at, at[start] + CHUNK_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, stop
        start = stop


def words(
    texts: pa.Array, space: np.ndarray = SPACE, fold: np.ndarray = LOWER
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes), text number and 64-bit hash of every word of ``texts``."""
    starts, ends, doc, total = bounds(texts, space, fold)
    return starts, ends, doc, span_hash(total, starts, ends)


def bounds(
    texts: pa.Array, space: np.ndarray = SPACE, fold: np.ndarray = LOWER
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, and the running sums that ``span_hash`` needs."""
    raw, at = flat(texts)
    raw = fold[raw]
    inside = ~space[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True  # also where the bytes end
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | np.concatenate((~inside[1:], [True])))) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw))[: len(raw)], out=total[1:])
    return starts, ends, np.searchsorted(at, starts, "right") - 1, total


def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, wherever they lie."""
    return mix((total[ends] - total[starts]) * _powers(_INVERSE, len(total))[starts])


def shingles(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``size``-word shingles.

    Fewer words make one shingle; none makes an empty set.
    """
    _, _, doc, hashes = words(texts)
    counts = np.bincount(doc, minlength=len(texts))
    edges = np.concatenate(([0], np.cumsum(counts)))
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled += hashes[k : k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    out = []
    for i, n in enumerate(counts):
        a = edges[i]
        if n >= size:
            mine = np.sort(rolled[a : a + n - size + 1])
            out.append(mine[np.concatenate(([True], mine[1:] != mine[:-1]))])
        elif n:
            short = (hashes[a : a + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
