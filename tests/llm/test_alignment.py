"""Alignment against a plain version over the libraries' own ids."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from recloom.llm import alignment

SCHEMA = "doc_id long, text string, pairs string, row string, n_a string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = alignment.default_vocabularies()
    first = Tokenizer.from_file(a)
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=b)


def plain_tokens(models, text):
    """Ids and bytes of both sides, of the whole text in one go."""
    first, second = models
    a = first.encode(" " + text, add_special_tokens=False).ids
    byte = alignment._byte_of()
    a_bytes = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
    b = second.encode(text)
    b_bytes = [
        bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in ((i, second.id_to_piece(i)) for i in b)
    ]
    return a, a_bytes, b, b_bytes


def plain(models, rows):
    docs, counts = [], Counter()
    for i, text in rows:
        a, a_bytes, b, b_bytes = plain_tokens(models, text) if text else ([], [], [], [])
        want = b" " + (text or "").encode()
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            docs.append((i, 0, 0, [], []))
            continue
        a_end, b_end = np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()
        groups, at, bt = [], 0, 0
        for e in sorted(set(a_end) & set(b_end)):
            x, y = a_end.index(e, at) + 1, b_end.index(e, bt) + 1
            groups.append((a[at:x], b[bt:y]))
            at, bt = x, y
        # ends rise strictly, so each place that both lists have gives one pair
        where = dict(zip(b_end, b, strict=True))
        links = [(k, where[e]) for k, e in zip(a, a_end, strict=True) if e in where]
        counts.update(links)
        docs.append((i, len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, n_a, n_b, groups, links in docs:
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if told else ""
        good = sum(counts[x] == best[x[1]] for x in links)
        out.append((i, n_a, n_b, len(groups), len(links), good, sum(counts[x] for x in links), digest))
    return out


def check(spark, models, rows, **how):
    got = alignment.alignment(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA), **how)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(models, rows)))


def test_matches_the_libraries(spark, models):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check(spark, models, [(r.doc_id, r.text) for r in docs])


@pytest.mark.parametrize("hot", [0, 7])
def test_rare_pairs_are_joined(spark, models, hot):
    check(spark, models, [(i, f"some words {i % 3} über all the {'words ' * (i % 4)}") for i in range(60)], hot=hot)


def test_edge_rows(spark, models):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "the same text"), (3, "the same text"), (4, " "), (5, "  two  spaces "),
            (6, "a <|endoftext|> b </s> <s> <0x41> <unk>"), (7, "▁ a mark ▁▁x"), (8, "\0\x01\n\r\t　\xa0"), (9, "日本語 😀 é é"),
            (10, "﻿​ x"), (11, "x" * 3000), (12, "ﬁ ½ Ⅳ ａ")]
    check(spark, models, rows)
    assert alignment.alignment(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_give_the_same_as_whole_texts(spark, models, monkeypatch):
    random = np.random.default_rng(6)
    words = ["word", "Ünï", "  ", "1234", "don't", "\n", "　x", " \t", "😀", "-", "▁", "it 's", "<s>", "\x1c", "e\u0301", "\u0301"]
    texts = [" ".join(random.choice(words, 4000)) for _ in range(8)]
    texts += [t.replace("▁", "_") for t in texts]
    aligner = alignment.Aligner(alignment.default_vocabularies())
    for text in texts:
        got, (a, _, b, _) = aligner.align([text]), plain_tokens(models, text)
        w = got.words
        assert len(got.codes) > 1000 or "▁" in text
        if len(got.codes):
            assert w.a[got.spread(w.a_at, w.a_n, got.codes)].tolist() == a
            assert w.b[got.spread(w.b_at, w.b_n, got.codes)].tolist() == b
    long = [(1, " ".join(random.choice(words[:2], 200_000))), (2, "a" + " " * 60_000 + "b"), (3, texts[0]), (4, texts[-1])]
    check(spark, models, long)
    monkeypatch.setattr(alignment, "REMEMBERED", 10)  # words are forgotten between chunks
    forgetful = alignment.Aligner(alignment.default_vocabularies())
    for text in texts:
        one, two = aligner.align([text, "and more"]), forgetful.align([text, "and more"])
        assert aligner.digests(one) == forgetful.digests(two)


def test_groups_give_the_text_back(spark, models):
    rows = [(1, "Some über-long words, 12 of them"), (2, None), (3, "x")]
    got = {r.doc_id: r for r in alignment.align(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)).collect()}
    assert got[2].a_ids == got[2].b_ids == got[2].a_ends == got[2].b_ends == []
    for i in (1, 3):
        a, a_bytes, b, b_bytes = plain_tokens(models, rows[i - 1][1])
        assert (got[i].a_ids, got[i].b_ids) == (a, b)
        for x, y in zip(got[i].a_ends, got[i].b_ends, strict=True):
            assert b"".join(a_bytes[:x]) == b"".join(b_bytes[:y])
        assert (got[i].a_ends[-1], got[i].b_ends[-1]) == (len(a), len(b))
