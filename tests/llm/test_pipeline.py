"""The pipeline against plain versions of its stages, and the registered corpus queries."""

import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from recloom.llm import toxicity
from tests.llm.test_line_runs import plain_texts
from tests.llm.test_near_duplicates import plain_documents
from tests.llm.test_spans import hidden
from tests.llm.test_tokens import token_ids

SF = "/root/testdata/sf0.001"


def blank(text):
    """Base secrets, overlapping ones merged, as marks."""
    out, at = "", 0
    spans = []
    for start, _, _, end in sorted(hidden(text)):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    for start, end in spans:
        out, at = out + text[at:start] + "[SECRET]", end
    return out + text[at:]


def test_whole_run_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = toxicity.score(docs, model).filter("score < 0.5").collect()
    lines = plain_texts([(r.doc_id, r.text) for r in clean])
    kept = [(i, dict(lines)[i]) for i, _, component in plain_documents(sorted(lines)) if i == component]
    want = {i: ids for (i, _), ids in zip(kept, token_ids([blank(t) for _, t in kept]), strict=True)}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    for i, rows in got.items():
        assert sum(r.length for r in rows) == len(want[i])
        for r in rows:
            part = np.array(want[i][r.start : r.start + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32


def test_stages_keep_the_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
    rows = [(1, "a fine text of some words " * 3, "en", "s", 78, 1.0, "k"), (2, None, None, None, None, None, None),
            (3, "", "en", "s", 0, 0.0, ""), (None, "token=abcdefghi and more", "en", None, 5, 0.0, ""),
            (1, "a fine text of some words " * 3, "en", "s", 78, 1.0, "k")]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = frame.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.columns == [c.split()[0] for c in schema.split(", ")]
            assert frame.count() == n
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == n


def test_no_row_or_column_is_lost(spark):
    """Rows that share an id are documents of their own; columns named like helper columns come back."""
    base = " ".join(f"word{k}" for k in range(40))
    names = "lines_removed, Chars_removed, toxicity, node, text_key, row, key, kept, score"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + names.replace(",", " string,") + " string"
    rows = [(1, base), (2, base), (2, "an own text of the same id, nothing like the other"), (2, base), (3, base + " more"),
            (None, base), (9, "last one"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *"abcdefghi") for i, t in rows], schema)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    got = sorted((str(r.doc_id), r.text or "") for r in left.collect())
    assert got == sorted([("1", base), ("2", rows[2][1]), ("None", base), ("9", "last one"), ("2", "")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {tuple(r)[5:] for r in out.collect()} == {tuple("abcdefghi")}


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "near duplicates", "secrets", "packing",
    ]


@pytest.mark.parametrize("number", range(1, 14))
def test_one_query_each(number):
    assert len([q for q in entry.queries() if re.match(rf"op{number}_", q)]) == 1
