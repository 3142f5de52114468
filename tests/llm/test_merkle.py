"""The manifest against plain hashing, proof by proof."""

import hashlib
import zlib

import numpy as np

from recloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree long, pos int"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The root, and of each node its (left, right) siblings from below."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(own):
            a = at - at % 16
            paths[k].append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + 16])))
        nodes = [H("".join(nodes[a : a + 16])) for a in range(0, len(nodes), 16)]
        own = [at // 16 for at in own]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = (mine, *plain_tree([plain_leaf(r) for r in mine]))
    root, tops = plain_tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        mine, subroot, paths = trees[s]
        for r, path in zip(mine, paths, strict=True):
            path = path + top
            node = plain_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = plain_leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                node = H(left + node + right)
            proof = H("".join(a + b for a, b in path))
            out.append((r[0], plain_leaf(r), subroot, root, proof, node, node == root))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = merkle.audit(frame)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows)))


def test_every_proof_matches_plain_hashing(spark):
    random = np.random.default_rng(5)
    rows = []
    for i in range(900):  # one source with a third of all rows: three levels
        source = "hot" if i % 3 == 0 else [None, "", "a", "ä", "B", "0", "z" * 300][int(random.integers(7))]
        rows.append((i, source, None if i % 7 == 0 else "en", i % 11 or None, f"Text {i} Ä\n" * (i % 4) or None))
    rows += [(i + 5000, f"lone {i:03d}", "en", 0, "A") for i in range(300)]  # three levels above the subroots
    check(spark, rows)


def test_sizes_around_full_runs(spark):
    rows = []
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 272, 273):
        rows += [(1000 * n + i, f"s{n}", "en", 1, "Aa") for i in range(n)]
    check(spark, rows)


def test_edge_rows(spark):
    check(spark, [(7, "s", "en", 3, "ABC")])
    check(spark, [(5, None, None, None, None)])
    same = (12, "s", "en", 3, "No matter")
    check(spark, [same, same, (12, "s", "en", 3, "other"), (None, "s", "en", 3, "A"), (None, None, None, None, ""), (4, "s", "", 0, "")])
    check(spark, [(i, "s", "en", 3, "Long TEXT " * 100_000) for i in range(3)])
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_every_second_level_is_written(spark):
    leaves = spark.range(5000).selectExpr("'1s' as tree", "id as doc_id", "sha2(string(id), 256) as digest")
    manifest = merkle.build(leaves, ["doc_id"])
    assert [level.count() for level in manifest.groups.levels] == [5000, 20, 1]
    assert manifest.root == plain_tree([H(str(i)) for i in range(5000)])[0]
