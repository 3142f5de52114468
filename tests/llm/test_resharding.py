"""Resharding: the flow against enumeration, the rows against their capacities, files against their rows."""

import itertools
import zlib

import numpy as np

from recloom.llm import resharding

SCHEMA = "doc_id long, text string, size string, shard string, slot string"


def cheapest(sizes, capacities, zone, far):
    """The least cost over all ways to send whole units."""

    def ways(amount, room):
        if len(room) == 1:
            if amount <= room[0]:
                yield (amount,)
            return
        for k in range(min(amount, room[0]) + 1):
            for rest in ways(amount - k, room[1:]):
                yield (k, *rest)

    def least(old, room):
        if not old:
            return 0
        i, best = old[0], None
        for way in ways(sizes[i], room):
            cost = sum(n * (0 if i == j else 1 if zone(i) == zone(j) else far) for j, n in enumerate(way))
            rest = least(old[1:], [a - b for a, b in zip(room, way, strict=True)])
            if rest is not None and (best is None or cost + rest < best):
                best = cost + rest
        return best

    return least(sorted(sizes), list(capacities))


def test_flow_is_cheapest():
    random = np.random.default_rng(2)
    for _ in range(60):
        n, m = random.integers(1, 4), random.integers(1, 4)
        sizes = {int(i): int(random.integers(0, 5)) for i in random.choice(5, n, replace=False)}
        capacities = resharding.even(sum(sizes.values()), m)
        if random.integers(2):
            capacities = [c + int(random.integers(0, 3)) for c in capacities]
        zone = [lambda s: 0, lambda s: s % 2][random.integers(2)]
        blocks = resharding.transfers(sizes, capacities, zone=zone, far=3)
        paid = sum((b.high - b.low) * (0 if b.old == b.new else 1 if zone(b.old) == zone(b.new) else 3) for b in blocks)
        assert paid == cheapest(sizes, capacities, zone, 3)
        for i, size in sizes.items():
            edges = [(b.low, b.high) for b in blocks if b.old == i]
            assert [a for a, _ in edges] + [size] == [0] + [b for _, b in edges] if size else not edges
        for j, room in enumerate(capacities):
            assert sum(b.high - b.low for b in blocks if b.new == j) <= room


def run(spark, rows, **how):
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = resharding.reshard(frame, **how)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard"]
    return got.collect()


def check(rows, got):
    key = lambda i, t: (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(key(i, t) for i, t in rows) == sorted((str(r.doc_id), r.size, r.text_crc32) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for mine in by.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    return {j: sum(r.size for r in mine) for j, mine in by.items()}


def test_sizes_are_near_equal_and_little_moves(spark):
    random = np.random.default_rng(4)
    rows = [(i, "ä" * int(random.lognormal(4, 1.2))) for i in range(4000)]
    rows += [(i + 10_000, "the hot text " * 6) for i in range(2000)]  # a third of all rows
    got = run(spark, rows)
    sizes = check(rows, got)
    assert set(sizes) == set(range(16))
    mean = sum(sizes.values()) / 16
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * mean
    old = {}
    for r in got:
        old[r.old_shard] = old.get(r.old_shard, 0) + r.size
    least = sum(max(n - mean, 0) for n in old.values())
    assert sum(r.size for r in got if r.shard != r.old_shard) < 1.02 * least + 200


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, None), (3, "x" * 400_000), (3, "x" * 400_000), (4, "a"), (4, "a")]
    assert sum(check(rows, run(spark, rows)).values()) == 800_002 + 3 + 4
    same = [(7, "one text")] * 400
    sizes = check(same, run(spark, same))
    assert max(sizes.values()) - min(sizes.values()) <= 9
    assert run(spark, []) == []
    check([(5, "only")], run(spark, [(5, "only")]))


def test_only_losing_shards_are_rewritten(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 7 + 1), i % 4) for i in range(600)] + [(i + 1000, "more " * 9, 0) for i in range(300)]
    rows += [(None, "more " * 9, 0)] * 20
    frame = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, shard int, note string")
    layout = resharding.write_layout(frame, str(tmp_path / "old"))
    after, rewritten = resharding.rewrite(spark, layout, 5, str(tmp_path / "new"))
    assert rewritten == [0]
    for k in (1, 2, 3):  # these only receive
        assert after[k][0] == layout[k][0] and len(after[k]) == 2
    assert layout[0][0] not in itertools.chain(*after.values())
    got = resharding.read_layout(spark, after).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.note) for r in got))) == sorted(map(str, ((i, t, "kept") for i, t, _ in rows)))
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + len(r.text) + 1
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) < 200
    again, rewritten = resharding.rewrite(spark, {k: v for k, v in layout.items() if k}, 4, str(tmp_path / "third"))
    assert 0 in again and set(rewritten) <= {1, 2, 3}
