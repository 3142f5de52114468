"""Disguises inside texts, through the choice of what is decoded."""

import pyarrow as pa
import pytest

from recloom.llm.deobfuscate import Restorer, log_model, trigram_counts


@pytest.fixture(scope="module")
def restorer(spark):
    text = "you idiot the stupid loser is a moron and good book and the moon is too big, see all of it. " * 20
    return Restorer(log_model(trigram_counts(spark.createDataFrame([(text,)], "text string"))))


def restore(restorer, *texts):
    return restorer.restore(pa.array(texts, pa.large_string())).to_pylist()


DISGUISES = [
    ("1d10t", "idiot"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("l0ser", "loser"), ("stup*d", "stupid"),
    ("idiooooot", "idiot"), ("$tup1d", "stupid"), ("boook", "book"), ("loser", "loser"),
    ("1 d 1 0 t", "idiot"), ("1.d.1.0.t", "idiot"), ("m.0.r.0.n", "moron"), ("iddiott", "idiot"),
    ("ssttuuppiidd", "stupid"), ("st.up.id", "stupid"), ("st-upid", "stupid"), ("id__iot", "idiot"),
    ("i  d  i  o  t", "idiot"), ("i - d - i - o - t", "idiot"), ("I D I O T", "idiot"), ("stup**d", "stupid"),
]


@pytest.mark.parametrize(("seen", "meant"), DISGUISES)
def test_disguises_in_texts_are_restored(restorer, seen, meant):
    texts = [seen, f"see the {seen} and the moon", f"see the {seen}, the moon", f"the {seen}!"]
    got = restore(restorer, *texts)
    for text in got:
        assert meant in text.replace(",", " ").replace("!", " ").split()


def test_run_of_masks_reaches_the_decoder(restorer):
    assert restore(restorer, "you st***d") != ["you st***d"]


def test_numbers_and_other_scripts_stay(restorer):
    texts = ["in 2024 and 1 2 3", "日日 本 語 語", "the end. 10,000", "", "a", "b", "c", "the book is good"]
    assert restore(restorer, *texts) == texts


def test_other_letters_pass_through_the_decoder(restorer):
    assert restore(restorer, "日本l0ser", "é é") == ["日本loser", "é é"]
