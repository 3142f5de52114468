"""Hand-computed edge rows of the feature tables, eligibility and scalar semantics."""

from datetime import datetime
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from recloom.functions import scalars
from recloom.operators import checks, joins, policy
from recloom.plans import eligibility, features
from recloom.session import shared_dir
from recloom.sources import tables, versions

AS_OF = "2024-07-01 12:00:00"


def rounds(spark, rows):
    return spark.createDataFrame(
        [(p, g, datetime.fromisoformat(t), Decimal(s), Decimal(o)) for p, g, t, s, o in rows],
        "player_id BIGINT, game_title_id BIGINT, round_start_timestamp TIMESTAMP_NTZ,"
        " stake_total_amt_eur DECIMAL(18,6), payout_total_amt_eur DECIMAL(18,6)",
    )


@pytest.fixture(scope="module")
def dims(spark):
    regions = tables.literal_rows(
        spark, "region_dim", [(1, None, "UK", "Kingdom", None, None, True), (2, None, "ES", "Spain", None, None, True)]
    )
    categories = spark.createDataFrame(
        [(1, "casino", "slots", "Slots"), (2, "casino", "jackpot", "Jackpot"), (6, "live", "live_roulette", "Roulette")],
        "category_id BIGINT, vertical STRING, subvertical STRING, category_name STRING",
    )
    items = spark.createDataFrame(
        [
            (10, 1, "A", True, True, None),
            (11, 2, "B", True, False, "ES"),
            (12, 6, "C", True, False, None),
            (13, 6, "D", False, True, None),
        ],
        "game_title_id BIGINT, category_id BIGINT, game_title STRING, available_for_play_yn BOOLEAN,"
        " is_global_yn BOOLEAN, home_region_code STRING",
    )
    for name, value in {
        "studio_name": F.lit("S"),
        "return_to_player_pct": F.lit(95).cast("decimal(6,2)"),
        "has_jackpot_yn": F.lit(False),
        "tile_image_url": F.lit(""),
        "tile_color_hex": F.lit(""),
    }.items():
        items = items.withColumn(name, value)
    players = spark.createDataFrame(
        [(1, 1, "CASUAL"), (2, 2, "CASUAL")], "player_id BIGINT, region_id BIGINT, player_segment STRING"
    )
    return regions, categories, items, players


ROWS = [
    (1, 10, "2024-06-30 12:00:00", "1.5", "0.5"),
    (1, 10, "2024-06-24 12:00:00", "2", "1"),  # exactly seven days: counted
    (1, 11, "2024-06-24 11:59:59.999999", "4", "0"),  # just outside seven days
    (1, 12, "2024-05-15 00:00:00", "8", "9"),  # in the 30..60 day window
    (1, 12, "2023-01-01 00:00:00", "1", "1"),  # old: weight at the floor
    (1, 10, "2024-07-01 12:00:00", "100", "0"),  # at as_of: not yet
]


def test_behavior(spark, dims):
    regions, categories, items, players = dims
    rolled = features.player_item_rollup(rounds(spark, ROWS), AS_OF)
    out = {
        r.player_id: r for r in features.player_behavior(rolled, players, regions, items, categories, AS_OF).collect()
    }
    one, two = out[1], out[2]
    assert (one.total_rounds, one.distinct_games, one.rounds_7d, one.rounds_30d, one.rounds_90d) == (5, 3, 2, 3, 4)
    assert one.total_stake_eur == 16.5 and one.total_ggr_eur == 5.0 and one.avg_stake_eur == 16.5 / 5
    assert one.days_since_last_play == 1
    assert (one.pref_vertical, one.pref_subvertical) == ("casino", "live_roulette")  # 2:2 tie, lowest name
    assert (two.total_rounds, two.total_stake_eur, two.avg_stake_eur) == (0, 0.0, 0.0)
    assert two.last_activity_ts is None and two.pref_vertical is None


def test_affinity(spark, dims):
    _, categories, items, _ = dims
    rolled = features.player_item_rollup(rounds(spark, ROWS), AS_OF)
    columns = {1: "aff_slots", 2: "aff_jackpot", 6: "aff_live_roulette"}
    (row,) = features.player_affinity(rolled, items, categories, columns).collect()
    weights = {1: (180 - 1) + (180 - 7), 2: 180 - 7, 6: (180 - 47) + 9}
    total = sum(weights.values())
    assert row.affinity_weight_total == pytest.approx(total / 180)
    assert row.aff_slots == weights[1] / total and row.aff_live_roulette == weights[6] / total
    long = {r.category_id: r.affinity for r in features.affinity_long(
        features.player_affinity(rolled, items, categories, columns), columns).collect()}
    assert long[2] == row.aff_jackpot


def test_item_profile_keeps_unplayed_items(spark, dims):
    _, categories, items, _ = dims
    rolled = features.player_item_rollup(rounds(spark, ROWS), AS_OF)
    out = {r.game_title_id: r for r in features.item_profile(rolled, items, categories).collect()}
    assert out[10].rounds_30d == 2 and out[10].players_30d == 1 and out[10].popularity_trend == 2.0
    assert out[12].rounds_30d == 0 and out[12].rounds_prev_30d == 1 and out[12].popularity_trend == 0.0
    assert out[13].rounds_30d == 0 and out[13].ggr_30d_eur == 0.0 and out[13].last_played_ts is None


def policies(spark, blocks=(), market=(), category=(), subvertical=()):
    return {
        "market_game_block": spark.createDataFrame(list(blocks), "region_code STRING, game_title_id BIGINT"),
        "market_category_exclusion": spark.createDataFrame(list(market), "region_code STRING, category_id BIGINT"),
        "player_category_exclusion": spark.createDataFrame(list(category), "player_id BIGINT, category_id BIGINT"),
        "player_subvertical_exclusion": spark.createDataFrame(list(subvertical), "player_id BIGINT, subvertical STRING"),
    }


def test_three_valued_eligibility(spark, dims):
    regions, categories, items, _ = dims
    rules = policies(spark, blocks=[("UK", 10), ("UK", 10), ("ES", 12)], market=[("UK", 1)])
    out = {
        (r.region_code, r.game_title_id): (r.is_eligible, r.ineligible_reason)
        for r in eligibility.market_eligible(regions, items, categories, rules).collect()
    }
    assert len(out) == 8  # duplicate rules do not repeat rows
    assert out[("UK", 10)] == (False, "MARKET_GAME_BLOCK")  # before the category rule
    assert out[("UK", 11)] == (False, "NOT_IN_MARKET")
    assert out[("ES", 11)] == (True, None)
    assert out[("UK", 12)] == (None, None)  # not global, no home market
    assert out[("ES", 12)] == (False, "MARKET_GAME_BLOCK")
    assert out[("UK", 13)] == (False, "GAME_UNAVAILABLE")


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.div0(F.lit(1), F.lit(0)).alias("zero"),
        scalars.div0(F.lit(1), F.lit(None).cast("int")).alias("null"),
        scalars.trend_index(F.lit(1), F.lit(8)).alias("half_even"),
        scalars.trend_index(F.lit(0), F.lit(0)).alias("no_rounds"),
        scalars.match_percent(F.lit(0.125)).alias("half_up"),
        scalars.match_percent(F.lit(1.7)).alias("capped"),
        scalars.recency_norm(F.lit(25)).alias("saturated"),
        scalars.fill_feature(F.lit(float("nan"))).alias("nan"),
        scalars.resolve_region(F.lit(""), F.lit("SE"), "^[A-Za-z]{2,5}$", "UK").alias("home"),
        scalars.resolve_region(F.lit("x'; --"), F.lit("SE"), "^[A-Za-z]{2,5}$", "UK").alias("bad"),
        scalars.resolve_region(F.lit(None).cast("string"), F.lit(None).cast("string"), "^[A-Za-z]{2,5}$", "UK").alias("none"),
    ).first()
    assert row.asDict() == {
        "zero": 0.0, "null": None, "half_even": 12, "no_rounds": 0, "half_up": 13, "capped": 100, "saturated": 1.0,
        "nan": 0.0, "home": "SE", "bad": "UK", "none": "UK",
    }


def test_feature_group_refuses_collisions(spark):
    left = spark.createDataFrame([(1, 2)], "player_id BIGINT, a INT")
    with pytest.raises(ValueError, match="collide"):
        joins.feature_group([left, left], "player_id")


def test_policy_edits_and_versions(spark, tmp_path):
    schema = "region_code STRING, game_title_id BIGINT, reason STRING, updated_at TIMESTAMP_NTZ, updated_by STRING"
    current = spark.createDataFrame([("ES", 1, "old", None, "seed")], schema)
    adds = spark.createDataFrame([("ES", 1, "again"), ("ES", 2, " new ")], "region_code STRING, game_title_id BIGINT, reason STRING")
    keys = ["region_code", "game_title_id"]
    after = policy.add_rules(current, adds, keys, AS_OF, "tester")
    assert {(r.game_title_id, r.reason, r.updated_by) for r in after.collect()} == {(1, "old", "seed"), (2, "new", "tester")}
    with pytest.raises(Exception, match="reason"):
        policy.add_rules(current, adds.withColumn("reason", F.lit("  ")), keys, AS_OF, "tester").collect()
    root = str(tmp_path)
    assert versions.publish(current, root, "market_game_block") == 1
    assert versions.publish(policy.remove_rules(after, current, keys), root, "market_game_block") == 2
    assert [r.game_title_id for r in versions.current(spark, root, "market_game_block").collect()] == [2]
    changes = {r.game_title_id: r.change for r in policy.diff(current, after.filter("game_title_id = 2"), keys, ["reason"]).collect()}
    assert changes == {1: "REMOVED", 2: "ADDED"}


def test_shared_folder_is_never_local_on_a_cluster(spark):
    def session(master, named=None, checkpoint=None):
        context = SimpleNamespace(master=master, applicationId=f"{master}-app", getCheckpointDir=lambda: checkpoint)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)

    assert shared_dir(session("spark://x", named="s3://shared/tmp")) == "s3://shared/tmp"
    assert shared_dir(session("spark://x", checkpoint="hdfs://shared")) == "hdfs://shared"
    assert shared_dir(session("local[2]")) == shared_dir(session("local[2]"))
    with pytest.raises(RuntimeError, match="shared by the cluster"):
        shared_dir(session("yarn"))
    assert spark.sparkContext.getCheckpointDir() is None or shared_dir(spark)


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k INT")
    assert [(r.k, r.rows) for r in checks.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert checks.uniqueness(df, "k").first().is_unique is False


def test_defaults_of_declared_tables(spark):
    row = tables.conform(spark.createDataFrame([(5,)], "game_title_id BIGINT"), "game_title_dim").first()
    assert row.is_global_yn is True and row.has_jackpot_yn is False and row.game_title is None


def test_preferred_subvertical_adds_up_over_verticals(spark, dims):
    regions, _, _, players = dims
    categories = spark.createDataFrame(
        [(1, "casino", "table"), (2, "casino", "slots"), (3, "live", "slots")],
        "category_id BIGINT, vertical STRING, subvertical STRING",
    )
    items = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "game_title_id BIGINT, category_id BIGINT")
    rows = [(1, game, "2024-06-30 10:00:00", "1", "0") for game in [10] * 5 + [11] * 3 + [12] * 3]
    rolled = features.player_item_rollup(rounds(spark, rows), AS_OF)
    one = features.player_behavior(rolled, players, regions, items, categories, AS_OF).filter("player_id = 1").first()
    assert (one.pref_vertical, one.pref_subvertical, one.total_rounds) == ("casino", "slots", 11)
