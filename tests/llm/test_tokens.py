"""Packing and pieces against the tokenizers themselves."""

import zlib

import numpy as np
import pytest

from recloom.llm.packing import Mixture, default_tokenizer, pack
from recloom.llm.pieces import Pieces, decode, default_model, encode

DOCS = "doc_id long, text string, source string, length string"


def token_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_pieces(rows, texts):
    """Every id in one piece, sequences full and gapless; returns the tokens of each queue by sequence."""
    ids = dict(zip(texts, token_ids(texts.values()), strict=True))
    places, share = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        places.setdefault(("doc", r.doc_id), []).append((r.start, r.length))
        places.setdefault(("sequence", r.sequence_id), []).append((r.offset, r.length))
        share.setdefault(r.sequence_id, {}).setdefault(r.source_queue, 0)
        share[r.sequence_id][r.source_queue] += r.length
    for key, spans in places.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        if key[0] == "doc":
            assert at == len(ids[key[1]])
        else:
            assert at == 2048 or key[1] == max(share)
    assert {k for w, k in places if w == "doc"} == set(ids)
    assert sorted(share) == list(range(len(share)))
    return [share[s] for s in sorted(share)]


def corpus(n=300):
    random = np.random.default_rng(4)
    words = ["Über", "it's", "l'été", "x²", "covfefe", "don't", "🙂", "12345", "é", "a b", "plain", "words"]
    sources = ["big"] * 6 + ["mid"] * 3 + ["tiny", None]
    return [
        (i, " ".join(random.choice(words, int(random.integers(0, 300)))), sources[random.integers(len(sources))], "x")
        for i in range(n)
    ] + [(n, None, "big", "x"), (n + 1, "", "mid", "x"), (n + 2, "word " * 30_000, "tiny", "x")]


def test_every_window_has_the_mixture(spark):
    rows = corpus()
    got = pack(spark.createDataFrame(rows, DOCS)).collect()
    shares = check_pieces(got, {r[0]: r[1] for r in rows})
    for queue in {q for s in shares for q in s}:
        counts = [s.get(queue, 0) for s in shares[:-1]]
        assert max(counts) - min(counts) <= 2


def test_target_weights_and_larger_windows(spark):
    rows = corpus(200)
    frame = spark.createDataFrame(rows, DOCS)
    shares = check_pieces(pack(frame, weights={"big": 3.0, "mid": 1.0}).collect(), {r[0]: r[1] for r in rows})
    first = sorted(shares[0].values())
    assert first == pytest.approx([512, 1536], abs=2)
    check_pieces(pack(frame, window=8192).collect(), {r[0]: r[1] for r in rows})


def test_allotments_are_whole_and_never_fall():
    random = np.random.default_rng(2)
    for weights in (None, random.random(40)):
        totals = random.integers(0, 5000, 40).astype(float)
        mixture = Mixture(totals, totals if weights is None else weights)
        before = np.zeros(40, int)
        for tokens in range(0, int(totals.sum()) + 1, 97):
            now = mixture.allotted(tokens)
            assert now.sum() == tokens and (now >= before).all() and (now <= totals).all()
            before = now


def test_packing_edge_rows(spark):
    rows = [(1, "same", None, "x"), (1, "same", None, "x"), (None, "no id", "s", "x")]
    got = pack(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
    assert pack(spark.createDataFrame([], DOCS)).count() == 0


TEXTS = ["", "a  b", " lead", "tail ", "x\ny\tz", "Ａ full ﬁ", "é é", "   ", "🙂🙂 llll", "def  f(x):\n        return x",
         "It's 3.14, ok?", "▁ marked ▁▁x", "a\u0000b", "mixed123words_and-more", "ß" * 50]


def test_pieces_match_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=default_model())
    random = np.random.default_rng(9)
    letters = list("aeiountrs lldñé.,'AB1 ")
    texts = TEXTS + ["".join(random.choice(letters, int(random.integers(0, 60)))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decode(encode(frame)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id]), texts[r.doc_id]
        assert r.text == texts[r.doc_id].replace("▁", " ")


def test_pieces_edge_rows(spark):
    frame = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, None, 2)], "doc_id long, text string, ids int")
    assert sorted(len(r.ids) for r in encode(frame).collect()) == [0, 0, 2]
    assert encode(frame.limit(0)).count() == 0
    assert decode(spark.createDataFrame([(None, "old")], "ids array<int>, text string")).collect()[0].text is None


def test_common_beginnings_do_not_change_the_pieces():
    pieces = Pieces(default_model())
    words = sorted({"▁" + w[:k] for w in ("internationalisation", "international", "interne", "intern") for k in range(1, 21)})
    assert all(parts == pieces.merged(word) for word, parts in pieces.segment(words))
