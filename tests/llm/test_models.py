"""Toxicity and quality: held-out accuracy, restored words, the identity of the factorisation machine, edge rows."""

import numpy as np
import pytest

from recloom.llm import queries, toxicity
from recloom.llm.deobfuscate import decode, log_model, trigram_counts
from recloom.llm.quality import BUCKETS, FACTORS, STATISTICS, BINS, FactorisationMachine, quality

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, n_chars long"
LABELS = "doc_id long, toxic int, quality int"


@pytest.mark.parametrize(
    ("name", "label", "least"), [("op3_toxicity", "toxic", 0.94), ("op10_quality_machine", "quality", 0.97)]
)
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = queries.QUERIES[name](spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    text = "you idiot the stupid loser is a good book and the moon is too big, see all of it. " * 20
    return log_model(trigram_counts(spark.createDataFrame([(text,), (None,), ("",)], "text string")))


@pytest.mark.parametrize(
    ("seen", "meant"),
    [("1d10t", "idiot"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("l0ser", "loser"), ("stup*d", "stupid"),
     ("idiooooot", "idiot"), ("$tup1d", "stupid"), ("boook", "book"), ("loser", "loser"), ("", "")],
)
def test_disguises_are_decoded(model, seen, meant):
    assert decode(seen, model) == meant


def test_trigrams_cover_every_text(spark):
    frame = spark.createDataFrame([("ab",), ("ab",), (None,)], "text string")
    counts = {r.code: r.n for r in trigram_counts(frame).collect()}
    assert counts[(0 << 12) + (1 << 6) + 2] == counts[(1 << 12) + (2 << 6) + 0] == 2  # " ab" and "ab "


def test_disguised_words_count(spark):
    random = np.random.default_rng(0)
    words = ["moon", "river", "stone", "green", "paper", "window", "sugar", "table"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([*random.choice(words, 20), "idiot" if bad else "friend", *random.choice(words, 5)]), "s", 1))
        labels.append((i, int(bad), 1))
    rows += [(1000, "river stone 1d10t green", "s", 1), (1001, "river stone i d i o t green", "s", 1), (1002, None, "s", None),
             (1003, "", "s", 0), (1004, "moon " * 50_000, "s", 1), (None, "river stone idiot", "s", 1)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], LABELS)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 1004, None)] == [1, 1, 0, 0, 0, 1]
    model = toxicity.train(docs, known)
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "n_chars", "score"] and scored.count() == len(rows)


def test_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "some text", "s", 9), (1, "some text", "s", 9), (2, None, None, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    for run, score in ((toxicity.toxicity, 0.01), (quality, 0.5)):
        assert [r.score for r in run(docs, none).collect()] == pytest.approx([score] * 3)
        assert run(docs.limit(0), none).count() == 0


def test_quality_edge_rows(spark):
    rows = [(i, "fine words in a line, and more of them. " * 5 if i % 2 else "x$$$ y%%% z### " * 20, "s", 100) for i in range(200)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], LABELS)
    edge = [(900, None, "s", None), (901, "", "s", 0), (902, "fine words in a line. " * 20_000, "s", 1), (None, "a", "s", 1)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows + edge, DOCS), labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(200))
    assert all(0 <= got[i].score <= 1 for i in (900, 901, 902, None))


def test_pairs_by_the_identity():
    random = np.random.default_rng(1)
    width = BUCKETS + STATISTICS * BINS
    model = FactorisationMachine(0.3, random.normal(size=width), random.normal(size=(width, FACTORS)))
    number, value = random.choice(width, 9, replace=False), random.normal(size=9)
    want = 0.3 + sum(model.weights[number] * value)
    for i in range(9):
        for j in range(i):
            want += model.factors[number[i]] @ model.factors[number[j]] * value[i] * value[j]
    assert model.margin(number, value, np.array([0, 9]))[0][0] == pytest.approx(want)
