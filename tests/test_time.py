"""Trailing windows, as-of joins and ranks against brute force, with a hot key."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recloom.operators import ranking, trailing

START = datetime(2024, 1, 1)


def hot_events(n=600, seed=1):
    """A third of all events belong to player 0, category 1; some share their instant."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        player, category = (0, 1) if rng.random() < 0.34 else (rng.randint(1, 6), rng.randint(1, 3))
        ts = START + timedelta(minutes=rng.randint(0, 4000), microseconds=rng.choice([0, 0, 1, 999_999]))
        out.append((i, player, category, ts))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, player_id BIGINT, category_id BIGINT, ts TIMESTAMP_NTZ")


def brute(rows, events, hours):
    return {
        i: sum(
            1 for _, q, d, t in events if (q, d) == (p, c) and ts - timedelta(hours=hours) <= t < ts
        )
        for i, p, c, ts in rows
    }


def counted(spark, rows, events, windows):
    return trailing.trailing(
        frame(spark, rows), frame(spark, events), ["player_id", "category_id"], "ts", "ts", windows, {"n": F.lit(1)}
    )


def test_trailing_matches_brute_force(spark):
    events = hot_events()
    out = counted(spark, events, events, {"1h": 1, "24h": 24}).collect()
    assert len(out) == len(events)
    assert {r.id: r.n_1h for r in out} == brute(events, events, 1)
    assert {r.id: r.n_24h for r in out} == brute(events, events, 24)


def test_window_is_half_open(spark):
    ref = START + timedelta(days=3)
    events = [(1, 9, 1, ref), (2, 9, 1, ref - timedelta(hours=24)), (3, 9, 1, ref - timedelta(hours=24, microseconds=1))]
    (row,) = counted(spark, [(0, 9, 1, ref)], events, {"24h": 24}).collect()
    assert row.n_24h == 1  # the event at ref - 24 h counts, those at ref and before do not


def test_no_leak_from_later_events(spark):
    events = hot_events(200)
    spine = events[:50]
    before = {r.id: r.n_24h for r in counted(spark, spine, events, {"24h": 24}).collect()}
    last = max(ts for *_, ts in spine)
    later = [(10_000 + i, p, c, last + timedelta(seconds=i)) for i, (_, p, c, _) in enumerate(spine)]
    after = {r.id: r.n_24h for r in counted(spark, spine, events + later, {"24h": 24}).collect()}
    assert before == after


def test_rows_without_key_or_events_stay(spark):
    spine = [(1, None, 1, START), (2, 77, 1, START)]
    out = {r.id: r.n_24h for r in counted(spark, spine, hot_events(20), {"24h": 24}).collect()}
    assert out == {1: 0, 2: 0}


def test_as_of_matches_brute_force(spark):
    view, spine = hot_events(300, seed=2), hot_events(300, seed=3)
    got = {
        r.id: r.v_value
        for r in trailing.as_of(
            frame(spark, spine), frame(spark, view).withColumn("value", F.col("id")), ["player_id", "category_id"],
            "ts", "ts", ["value"], "v_",
        ).collect()
    }
    for i, p, c, ts in spine:
        seen = [(t, v) for v, q, d, t in view if (q, d) == (p, c) and t <= ts]
        assert got[i] == (max(seen)[1] if seen else None)


def test_latest(spark):
    events = hot_events(100)
    got = {r.player_id: r.ts for r in trailing.latest(frame(spark, events), ["player_id"], "ts").collect()}
    assert got == {p: max(t for _, q, _, t in events if q == p) for _, p, _, _ in events}


def test_ranks_and_samples_are_exact(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"))
    ranked = ranking.hash_rank(df, ["id"], 1, ["g"]).toPandas()
    for _, part in ranked.groupby("g"):
        assert sorted(part["hash_rank"]) == list(range(1, len(part) + 1))
    assert ranking.hash_sample(df, ["id"], 777).count() == 777
    assert ranking.hash_sample(df, ["id"], 99_999).count() == 5000
    one = {r.id for r in ranking.hash_sample(df.repartition(3), ["id"], 50).collect()}
    two = {r.id for r in ranking.hash_sample(df.repartition(7), ["id"], 50).collect()}
    assert one == two
    by_id = {r.id: r["rank"] for r in ranking.number_rank(df, "id").collect()}
    assert by_id == {i: i + 1 for i in range(5000)}
    split = ranking.stratified_split(df, "g", ["id"]).groupBy("g").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    assert all(r.t == int(r.n * 0.2) for r in split.collect())


def test_auc(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.2, 0.2, 0.5, 0.9, 1.0, rng.random()])) for _ in range(400)]
    wins = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z)
    pairs = sum(y for y, _ in rows) * sum(1 - y for y, _ in rows)
    got = ranking.auc(spark.createDataFrame(rows, "label INT, score DOUBLE"), "label", "score").first().auc
    assert abs(got - wins / pairs) < 1e-12
    assert ranking.auc(spark.createDataFrame([(1, 0.5)], "label INT, score DOUBLE"), "label", "score").first().auc is None
