"""Line dedup against plain repeated runs of lines and sentences, and its edge rows."""

import re

import numpy as np
import pytest

import corpus_pipeline
from recloom.llm.line_runs import LONG, dedup_runs

SCHEMA = "doc_id long, text string, lang string, chars_removed string"


def plain_units(text):
    """(line, unit) in turn."""
    out = []
    for line, body in enumerate(x for x in text.split("\n") if x):
        parts = re.split(r"(?<=[.!?])[ \t\r]+(?=\S)", body) if len(body.split()) > LONG else [body]
        out += [(line, x) for x in parts]
    return out


def plain_gone(rows):
    """Per document its units and the numbers of those to go; runs of any length are looked for at all earlier places."""
    docs = [plain_units(t) for _, t in sorted(rows)]
    places = {}
    for d, units in enumerate(docs):
        for i in range(len(units)):
            places.setdefault(units[i][1], []).append((d, i))
    for d, units in enumerate(docs):
        gone = set()
        for i in range(len(units)):
            for e, j in places[units[i][1]]:
                if (e, j) >= (d, i):
                    break
                n = 0
                while i + n < len(units) and j + n < len(docs[e]) and units[i + n][1] == docs[e][j + n][1]:
                    if e == d and j + n >= i:
                        break
                    n += 1
                if n >= 2 or n == 1 and len(units[i][1].split()) > LONG:
                    gone |= set(range(i, i + n))
        yield units, gone


def plain(rows):
    """Units that stay, by line."""
    out = []
    for units, gone in plain_gone(rows):
        kept = {}
        for i, (line, x) in enumerate(units):
            if i not in gone:
                kept.setdefault(line, []).append(x)
        out.append([" ".join(x) for x in kept.values()])
    return out


def plain_texts(rows):
    """(doc_id, text) without the units to go; line ends go with a line of which nothing stays."""
    out = []
    for (i, text), (units, gone) in zip(sorted(rows), plain_gone(rows), strict=True):
        begins, at = [], 0
        for _, unit in units:
            begins.append(text.index(unit, at))
            at = begins[-1] + len(unit)
        cut = set()
        for k in gone:
            line = units[k][0]
            last = k + 1 == len(units) or units[k + 1][0] != line
            whole = all(j in gone for j, (other, _) in enumerate(units) if other == line)
            follow = begins[k + 1] if k + 1 < len(units) else len(text)
            cut |= set(range(begins[k], begins[k] + len(units[k][1]) if last and not whole else follow))
        out.append((i, "".join(c for k, c in enumerate(text) if k not in cut)))
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", "old") for i, t in rows], SCHEMA)
    return sorted((r.doc_id, r.text, r.lines_removed, r.chars_removed) for r in dedup_runs(frame).collect())


def test_matches_plain_runs(spark):
    random = np.random.default_rng(3)
    words = ["ä", "be", "Cé", "dd", "日本"]
    say = lambda n: " ".join(random.choice(words, n))
    pool = [f"{say(4)} {k}" for k in range(40)]
    pool += [" ".join(f"{say(9)} {k} {s}{random.choice(list('.!?'))}" for s in range(8)) for k in range(8)]
    pool += [f"{say(60)} {k}" for k in range(4)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(random.integers(1, 5)):
            a = random.integers(0, len(pool))
            lines += [f"own {i} {random.integers(1000)}"] * random.integers(0, 2) + pool[a : a + random.integers(1, 6)]
        if i % 5 == 0:  # sentences of a long line, in another long line
            lines.append(" ".join([f"own {i} start {say(20)}.", *re.split(r"(?<=[.!?]) ", pool[41])[2:6], f"{say(20)} end {i}"]))
        rows.append((i, "\n".join(lines) + "\n" * (i % 3)))
    got = run(spark, rows)
    assert [[x.strip() for x in t.split("\n") if x.strip()] for _, t, _, _ in got] == plain(rows)
    for (_, old), (_, new, lines, chars) in zip(rows, got, strict=True):
        assert len(old) - len(new) == chars
        assert len([x for x in old.split("\n") if x]) - len([x for x in new.split("\n") if x]) == lines


@pytest.mark.parametrize("size", [2, 3, 4, 5])
@pytest.mark.parametrize("shift", [0, 1, 2])
def test_short_passages_go_whole(spark, size, shift):
    passage = [f"a planted passage {size} {k}" for k in range(size)]
    own = [f"own line {k}" for k in range(shift)]
    text = "\n".join([*own, *passage, "its own end"])
    got = run(spark, [(1, "\n".join(["begin", *passage, "end"])), (2, text)])
    assert got[1][1:3] == ("\n".join([*own, "its own end"]), size)


def test_long_line_alone_goes(spark):
    long = " ".join(f"This is sentence {k} of a long line of many words." for k in range(8))
    bare = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, bare), (4, f"e\n{bare}"), (5, "short line"), (6, "short line")]
    assert [x[1] for x in run(spark, rows)] == [rows[0][1], "c\nd", bare, "e\n", "short line", "short line"]


def test_runs_inside_one_text(spark):
    rows = [(1, "x\nx\nx"), (2, "y\ny\ny\ny"), (3, "p\nq\np\nq\np\nq\nr")]
    assert [x[1] for x in run(spark, rows)] == ["x\nx\nx", "y\ny\n", "p\nq\nr"]


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "only line"), (4, "only line"), (5, "\n\n\n"), (None, "only line"), (6, " . "), (6, "? ! .")]
    frame = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = dedup_runs(frame)
    assert got.columns == ["doc_id", "text", "lang", "lines_removed", "chars_removed"]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, rows))
    assert dedup_runs(frame.limit(0)).count() == 0
    text = "\n".join(f"line {k} of everything" for k in range(12))
    again = run(spark, [(i, text) for i in range(1, 200)] + [(0, text)] * 2)
    assert [t for _, t, _, _ in again] == [text, text] + [""] * 199
    assert [t for _, t, _, _ in run(spark, [(1, text), (2, text.upper())])] == [text, text.upper()]


def test_pipeline_stage_takes_short_passages(spark):
    passage = [f"a planted passage {k}" for k in range(3)]
    rows = [(i, "\n".join([f"own {i}", *passage, f"end {i}"]), "en", "s", 1) for i in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "own 2\nend 2"}
