"""Leak-free features against plain sums, and the promise that later rounds change nothing."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from recloom.plans import point_in_time, training
from recloom.plans.incremental import Decay
from recloom.schemas import FEATURE_COLS

COLUMNS = {1: "aff_one", 2: "aff_two", 3: "aff_three"}
T0 = datetime(2001, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    random = np.random.default_rng(4)
    items = [(g, g % 4 + 1, 90.0 + g) for g in range(1, 13)]  # category 4 has no column of its own
    rounds = []
    for k in range(2500):  # player 1 is hot
        player = 1 if k % 3 == 0 else int(random.integers(2, 12))
        at = T0 + timedelta(days=int(random.integers(0, 400)), hours=int(random.integers(0, 24)))
        rounds.append((player, int(random.integers(1, 14)), None if k % 90 == 0 else at))
    rows = []
    for k in range(300):
        at = rounds[k][2] or T0
        if k % 4 == 0:
            at = at.replace(hour=0)
        rows.append((f"r{k}", int(random.integers(1, 13)), int(random.integers(1, 13)), at))
    category = {g: c for g, c, _ in items}
    rows = [(i, p, g, category[g], at) for i, p, g, at in rows]
    return (
        spark.createDataFrame(rows, "row_id string, player_id long, game_title_id long, category_id long, ref_ts timestamp_ntz"),
        spark.createDataFrame(rounds, "player_id long, game_title_id long, round_start_timestamp timestamp_ntz"),
        spark.createDataFrame(items, "game_title_id long, category_id long, return_to_player_pct double"),
        rows, rounds, items,
    )


def plain(row, rounds, items, decay):
    _, player, item, cat, ref = row
    category = {g: c for g, c, _ in items}
    known = [(p, g, category[g], at) for p, g, at in rounds if g in category and at is not None]
    weight = lambda at: max(decay.low, (decay.horizon - (ref.date() - at.date()).days) * 100)
    own = [(c, weight(at)) for p, _, c, at in known if p == player and at < ref]
    asked = cat if cat in COLUMNS else 1
    total = sum(w for _, w in own)
    midnight = datetime(ref.year, ref.month, ref.day)

    def played(a, b):
        out = {}
        for _, g, _, at in known:
            if midnight - timedelta(days=a) <= at < midnight - timedelta(days=b):
                out[g] = out.get(g, 0) + 1
        return out

    now, ago = played(30, 0), played(60, 30)
    recent = sum(p == player and c == cat and ref - timedelta(hours=24) <= at < ref for p, _, c, at in known)
    active = sum(p == player and at is not None and ref - timedelta(days=30) <= at < ref for p, _, at in rounds)
    return {
        "aff_for_category": sum(w for c, w in own if c == asked) / total if total else 0.0,
        "game_rounds_30d_norm": now.get(item, 0) / max([1, *now.values()]),
        "popularity_trend": now.get(item, 0) / (ago.get(item, 0) + 1),
        "rtp_frac": {g: r for g, _, r in items}[item] / 100,
        "player_rounds_30d": float(active),
        "recent_cat_activity_norm": min(recent, 10) / 10,
    }


@pytest.mark.parametrize("decay", [Decay(), Decay(40, 0.1)])
def test_features_equal_plain_sums(tables, decay):
    frame, rounds, items, rows, raw, catalogue = tables
    got = {r.row_id: r for r in point_in_time.features_as_of(frame, rounds, items, COLUMNS, decay=decay).collect()}
    assert len(got) == len(rows)
    for row in rows:
        want = plain(row, raw, catalogue, decay)
        for name in FEATURE_COLS:
            assert got[row[0]][name] == pytest.approx(want[name], abs=1e-12), (row, name)


def test_later_rounds_change_nothing(tables, spark):
    frame, rounds, items, *_ = tables
    cut = T0 + timedelta(days=200)
    early = frame.filter(F.col("ref_ts") <= F.lit(cut))
    later = spark.range(3000).select(
        (F.col("id") % 11 + 1).alias("player_id"), (F.col("id") % 12 + 1).alias("game_title_id"),
        (F.lit(cut).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 90).cast("int"))).alias("round_start_timestamp"),
    )
    before = rounds.filter(F.col("round_start_timestamp") < F.lit(cut))
    read = lambda events: sorted(
        map(str, point_in_time.features_as_of(early, events, items, COLUMNS).select("row_id", *FEATURE_COLS).collect())
    )
    assert read(before) == read(before.unionByName(later)) == read(rounds)


def test_empty(tables):
    frame, rounds, items, rows, *_ = tables
    assert point_in_time.features_as_of(frame.limit(0), rounds, items, COLUMNS).count() == 0
    none = point_in_time.features_as_of(frame, rounds.limit(0), items, COLUMNS).collect()
    assert len(none) == len(rows) and {r.aff_for_category + r.game_rounds_30d_norm + r.popularity_trend for r in none} == {0.0}


def test_only_what_the_rows_ask_for_is_written(tables, monkeypatch):
    frame, rounds, items, *_, kinds = tables
    written = {}

    def counting(df, name, stage=point_in_time.stage):
        out = stage(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(point_in_time, "stage", counting)
    got = point_in_time.features_as_of(frame.filter("player_id = 2"), rounds, items, COLUMNS)
    want = point_in_time.features_as_of(frame, rounds, items, COLUMNS).filter("player_id = 2")
    own = rounds.filter("player_id = 2").count()
    assert sorted(map(str, got.select("row_id", *FEATURE_COLS).collect())) == sorted(
        map(str, want.select("row_id", *FEATURE_COLS).collect())
    )
    written.clear()
    point_in_time.features_as_of(frame.filter("player_id = 2"), rounds, items, COLUMNS)
    assert max(written.values()) < rounds.count() and own in written.values()


def test_daily_most_equals_the_days_counted_one_by_one(spark):
    random = np.random.default_rng(7)
    rows = {(int(random.integers(1, 6)), int(random.integers(0, 150))): int(random.integers(1, 9)) for _ in range(90)}
    start = T0.date()
    frame = spark.createDataFrame(
        [(g, start + timedelta(days=d), n) for (g, d), n in rows.items()], "game_title_id long, _on date, _n long"
    )
    want = {}
    for day in range(1, 200):
        sums = [sum(rows.get((g, d), 0) for d in range(day - 30, day)) for g in range(1, 6)]
        if max(sums):
            want[start + timedelta(days=day)] = max(sums)
    assert {r.day: r.most for r in point_in_time.daily_most(frame).collect()} == want


def test_recency_reads_the_events_of_the_rows_players(tables):
    frame, rounds, items, *_ = tables
    known = rounds.join(items, "game_title_id")
    few = training.recency_as_of(frame.filter("player_id = 2"), known, "round_start_timestamp")
    assert "LeftSemi" in few._jdf.queryExecution().optimizedPlan().toString()
    all_rows = training.recency_as_of(frame, known, "round_start_timestamp").filter("player_id = 2")
    assert sorted(map(str, few.collect())) == sorted(map(str, all_rows.collect()))
