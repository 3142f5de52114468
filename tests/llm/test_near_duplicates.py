"""Near-duplicate documents and vectors, and components, against brute force."""

import re
import string

import numpy as np
import pytest

from recloom.llm.components import components
from recloom.llm.metric_join import near_equal
from recloom.llm.minhash_join import near_duplicates
from recloom.llm.permutation_index import nearest_neighbours

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def reach(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_documents(rows):
    """(doc_id, text) with ids in ascending order: (id, size, component)."""
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    return [(rows[i][0], len(sets[i]), rows[r][0]) for i, r in enumerate(reach(len(rows), links))]


def test_documents_match_brute_force(spark):
    random = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, passage = [], " ".join(random.choice(vocabulary, 60))
    for group in range(12):
        base = list(random.choice(vocabulary, int(random.integers(5, 150))))
        for _ in range(int(random.integers(1, 30))):
            words = list(base)
            for _ in range(int(random.integers(0, max(2, len(base) // 25)))):
                words[random.integers(len(words))] = "x" + str(random.integers(1000))
            rows.append(" ".join(words).upper() if random.random() < 0.3 else "\t".join(words))
    rows += [passage + f" {i} " + " ".join(random.choice(vocabulary, 40)) for i in range(30)]
    rows += ["", None, "one", "One", "two words", "a a a a a a a a", "a a a a a a a a a a", "Ä b c d e", "ä b c d e"]
    numbered = [(i * 3, t) for i, t in enumerate(rows)]
    frame = spark.createDataFrame(numbered, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame).collect())
    # below 0.8 a link that signatures miss is possible, though very unlikely
    assert got == plain_documents(numbered)


def test_large_group_of_near_copies(spark):
    random = np.random.default_rng(6)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in random.integers(0, 120, int(random.integers(0, 7))):
            words[at] = f"e{random.integers(10_000)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame).collect())
    assert got == plain_documents(rows)


def test_document_edge_rows(spark):
    text = " ".join(f"t{i}" for i in range(20))
    rows = [(7, text, "a"), (7, text, "b"), (3, text + " end", "c"), (None, text, "d"), (9, None, "e"), (8, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = near_duplicates(frame).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (3, 3, True), (7, 3, False), (7, 3, False), (8, 8, True), (9, 9, True),
    ]
    assert near_duplicates(frame.limit(0)).count() == 0


def test_components(spark):
    random = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in random.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    links += [(500, i) for i in range(501, 700)] + [(5, None)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = reach(700, [(a, b) for a, b in links if b is not None])
    got = {r.node: r.component for r in components(frame, 10).collect()}
    assert all(want[n] == c for n, c in got.items())
    assert {n for a, b in links if b is not None and a != b for n in (a, b)} == set(got)
    assert components(frame.limit(0), 0).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, rank string"


def vectors(seed, n, width=16):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, width)).astype(np.float32)
    x[n // 2 : n // 2 + n // 4] = x[0] + random.normal(0, 0.12, (n // 4, width))  # near copies
    x[-n // 8 :] = x[1]  # copies
    return x


def test_vectors_match_brute_force(spark):
    x = vectors(2, 400)
    label = [None if i % 17 == 0 else i % 3 for i in range(400)]
    frame = spark.createDataFrame([(i, x[i].tolist(), label[i], "r") for i in range(400)], VECTORS)
    d = x.astype(np.float64)
    norm = np.sqrt((d**2).sum(1))
    near = (d @ d.T) / norm[:, None] / norm[None] >= 0.98
    pairs = [(i, j) for i in range(400) for j in range(i) if near[i, j] and label[i] == label[j] is not None]
    links = np.zeros(400, int)
    for i, j in pairs:
        links[[i, j]] += 1
    want = list(zip(range(400), links.tolist(), reach(400, pairs), strict=True))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_equal(frame).collect()) == want


def test_neighbours_reach_recall(spark):
    x = vectors(3, 3000, 32)
    frame = spark.createDataFrame([(i, x[i].tolist(), 0, "r") for i in range(3000)], VECTORS)
    found = {}
    for r in nearest_neighbours(frame).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits, d = 0, x.astype(np.float64)
    for q in range(0, 3000, 100):
        distance = np.sqrt(((d - d[q]) ** 2).sum(1))
        distance[q] = np.inf
        want = np.lexsort((np.arange(3000), distance))[:10]
        assert len(found[q]) == 10
        assert all(s == pytest.approx(distance[v], abs=1e-12) for v, s in found[q])
        assert found[q] == sorted(found[q], key=lambda p: (p[1], p[0]))
        hits += len(set(want) & {v for v, _ in found[q]})
    assert hits >= 0.9 * 300


def test_vector_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (100, [1.0, 0.01], 1), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1),
        (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (0, [1.0, 0.0], 1),
        (12, [1.0, 0.0, 0.0], 1),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in near_equal(frame).collect())
    assert got == [(-1, 0, None), (0, 2, 0), (0, 2, 0), *((i, 0, i) for i in (5, 6, 7, 8, 9, 10, 11, 12)), (100, 2, 0)]
    near = [(r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(frame).collect()]
    assert sorted(near) == [(0, 1, 11), (0, 2, 100), (100, 1, 0), (100, 2, 11)]
    assert near_equal(frame.limit(0)).count() == 0
    assert nearest_neighbours(frame.limit(0)).count() == 0
