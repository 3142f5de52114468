"""Line dedup by chunks: where they are cut, and that equality is that of bytes, not of hashes."""

import numpy as np

from recloom.llm import line_runs
from recloom.llm.line_runs import dedup_runs

SCHEMA = "doc_id long, key long, text string"


ALL = b"\xff" * 4096


def body_rows(spark, texts):
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], SCHEMA)
    rows = line_runs.repeats(frame, 0, 64, ALL).filter("units IS NOT NULL").collect()
    return sorted((r.doc_id, r.place, r.units, bytes(r.body or b"").decode()) for r in rows)


def test_every_pair_of_neighbours_lies_in_one_chunk(spark):
    texts = ["\n".join(f"line {i} {k} é" for k in range(n)) for i, n in enumerate([2, 3, 7, 40, 200])]
    rows = body_rows(spark, texts)
    for i, text in enumerate(texts):
        mine = [(place, n, body) for doc, place, n, body in rows if doc == i]
        lines = text.split("\n")
        assert sorted(p + k for p, n, _ in mine for k in range(n - 1)) == list(range(len(lines) - 1))
        assert all(body == "\n".join(lines[p : p + n]) for p, n, body in mine)
    assert len([r for r in rows if r[0] == 4]) > 20


def test_chunks_follow_their_content(spark):
    shared = [f"a shared line {k}" for k in range(60)]
    rows = body_rows(spark, ["\n".join(shared), "\n".join(["one", "two", "three", *shared])])
    one, two = ({body for doc, _, _, body in rows if doc == i} for i in (0, 1))
    assert len(one & two) >= len(one) - 2


def test_units_that_share_a_hash_stay_apart(spark):
    random = np.random.default_rng(5)
    pool = [f"line number {k}" for k in range(9)]
    rows = [(i, 0, "\n".join(random.choice(pool, random.integers(1, 7)))) for i in range(12)]
    frame = spark.createDataFrame(rows, SCHEMA).drop("key")
    weak = {r.doc_id: r.text for r in dedup_runs(frame, bits=2).collect()}
    assert weak == {r.doc_id: r.text for r in dedup_runs(frame).collect()}


def test_equal_bytes_cut_otherwise_are_no_copy(spark):
    # the end of a long line, cut into sentences, and the same bytes as short lines of their own
    tail = "Some words here. And some more."
    long = " ".join(["word"] * 60) + ". " + tail
    rows = [(1, 0, long + "\nlast"), (2, 0, tail + "\nlast"), (3, 0, tail + "\nlast")]
    got = {r.doc_id: r.text for r in dedup_runs(spark.createDataFrame(rows, SCHEMA).drop("key")).collect()}
    assert got == {1: rows[0][2], 2: rows[1][2], 3: ""}
