"""Line dedup against a plain loop over lines, and its edge rows."""

import numpy as np
import pyarrow as pa

from recloom.llm import text as tx
from recloom.llm.line_chunks import DIVISOR, LEAST_LINES, WINDOW, dedup_lines

SCHEMA = "doc_id long, text string, lang string, chars_removed string"


def line_hash(line: bytes) -> int:
    return int(tx.words(pa.array([line.decode()], pa.large_string()), tx.NEWLINE, tx.EXACT)[3][0])


def plain_chunks(text: str) -> list[list[str]]:
    """Lines (with the line ends after them) by chunk; leading line ends belong to none."""
    lines, hashes = [], []
    for line in text.splitlines(True) if "\r" not in text else [x + "\n" for x in text.split("\n")]:
        if line.strip("\n"):
            lines.append(line)
            hashes.append(line_hash(line.strip("\n").encode()))
        elif lines:
            lines[-1] += line
    out, start = [], 0
    for i in range(len(lines)):
        rolled = sum(hashes[i - k] * (2 * k + 1) for k in range(WINDOW) if i >= k) % 2**64
        end = int(tx.mix(np.array([rolled], np.uint64))[0]) % DIVISOR == 0
        if end and i + 1 - start >= LEAST_LINES:
            out.append(lines[start : i + 1])
            start = i + 1
    return out + [lines[start:]] if start < len(lines) else out


def plain(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows):
        kept = text[: len(text) - len(text.lstrip("\n"))]
        for chunk in plain_chunks(text):
            body = "".join(chunk).rstrip("\n")
            if len(chunk) >= LEAST_LINES and body in seen:
                continue
            seen.add(body)
            kept += "".join(chunk)
        out.append((doc_id, kept))
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", "old") for i, t in rows], SCHEMA)
    return sorted((r.doc_id, r.text) for r in dedup_lines(frame).collect())


def test_matches_plain_loop(spark):
    random = np.random.default_rng(3)
    pool = [" ".join(random.choice(["ä", "be", "Cé", "dd"], 4)) + f" {k}" for k in range(60)]
    shared = pool[:9]
    rows = []
    for i in range(60):
        own = [f"own {i} {k}" for k in range(random.integers(0, 6))]
        rows.append((i, "\n".join([*own, *shared[: random.integers(2, 10)], "", f"end {i}", *random.choice(pool, 5)])))
    got = run(spark, rows)
    assert got == plain(rows)
    assert sum(len(t) for _, t in got) < sum(len(t) for _, t in rows)


def test_shifted_passage_goes(spark):
    passage = [f"a shared line number {k}" for k in range(40)]
    rows = [(1, "\n".join(passage)), (2, "\n".join(["new first line", "another one", "third", *passage]))]
    (_, one), (_, two) = run(spark, rows)
    assert one == rows[0][1]
    assert len(two) < 0.35 * len(one)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "only line"), (4, "only line"), (5, "\n\n\n"), (None, "only line")]
    frame = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "lang", "lines_removed", "chars_removed"]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, rows))
    assert dedup_lines(frame.limit(0)).count() == 0


def test_repeated_rows_and_hot_chunk(spark):
    text = "\n".join(f"line {k} of everything" for k in range(12))
    rows = [(i, text) for i in range(300)] + [(0, text)]
    got = run(spark, rows)
    assert [t for i, t in got if i == 0] == [text, text]
    assert all(len(t) < 0.5 * len(text) for i, t in got if i)


def test_letter_case_is_a_difference(spark):
    text = "\n".join(f"line {k} of everything" for k in range(12))
    rows = [(1, text), (2, text.upper())]
    assert run(spark, rows) == rows
