"""What the physical plans must look like: pruned scans, no cross joins, no shuffled candidates."""

import re

import pytest
from pyspark.sql import functions as F

from recloom.functions import hashing
from recloom.operators import ranking
from recloom.plans import candidates, rails, training
from recloom.queries import candidates as bulk
from recloom.queries import features, joins, monitoring
from recloom.sources.star import AFFINITY, Star
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def star(spark):
    return Star(spark, SF_DIR)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(star):
    text = plan(features.ag2(star))
    read = {c for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in re.findall(r"(\w+):", schema)}
    assert "l_shipdate" in read and "l_tax" not in read and "l_extendedprice" not in read and "p_name" not in read


def test_time_filters_reach_the_scan(star):
    text = plan(joins.ag8(star))
    assert re.search(r"PushedFilters: \[[^\]]*l_shipdate", text), text[:3000]


@pytest.mark.parametrize("query", [features.rc1, features.ag10, joins.jn4, joins.jn5])
def test_no_cross_joins(star, query):
    text = plan(query(star))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_candidates_are_not_shuffled(star):
    """Requests are spread once; the product and every per-request window stay where they are."""
    done = bulk.run(star)
    market = bulk.staged_market(star)
    scored = candidates.assemble(done.requests, market, columns=AFFINITY).withColumnRenamed("rtp_frac", "score")
    text = plan(rails.diversify(candidates.kept(scored), 12))
    above_join, below = text.split("BroadcastHashJoin [region_code", 1)
    assert "Exchange" not in above_join and "WindowGroupLimit" in above_join
    assert "hashpartitioning(request_id" in below


def test_a_large_catalogue_is_not_broadcast(spark):
    market = spark.range(1, 601).selectExpr("concat('M', id % 3) AS region_code", "id AS game_title_id")
    asked = spark.range(1, 401).selectExpr("concat('q', id) AS request_id", "concat('M', id % 4) AS region_code")
    for requests in (asked.limit(40), asked):
        small, large = (candidates.expand(requests, market, most) for most in (600, 100))
        plan = large._jdf.queryExecution().executedPlan().toString()
        # few requests are broadcast to the items; many meet them over a shuffle, without any broadcast
        assert ("BroadcastExchange" in plan) == (requests is not asked) and ("SortMergeJoin" in plan) == (requests is asked)
        assert "BuildRight" not in plan
        names = ["request_id", "region_code", "game_title_id"]
        rows = sorted(large.select(names).collect())
        assert rows == sorted(small.select(names).collect()) and rows


def test_block_lists_are_not_shuffled(star):
    """What a trace shows joins the request before the block list of its market does."""
    text = bulk.run(star).traces._jdf.queryExecution().optimizedPlan().toString()
    outer = [line for line in text.splitlines() if "Join LeftOuter" in line]
    assert "region_code" in outer[0] and "request_id" in outer[1], outer


def test_order_lines_are_shuffled_once(star):
    text = monitoring.order_log(star)._jdf.queryExecution().optimizedPlan().toString()
    # players and markets are joined to the orders, below the only join of the lines
    assert "l_orderkey" in next(line for line in text.splitlines() if "Join" in line)


@pytest.mark.parametrize("query", [bulk.ag13_whole, bulk.rc5_whole])
def test_exclusions_roll_the_rounds_up_once(star, query, monkeypatch):
    made, rollup = [], bulk.rollup
    monkeypatch.setattr(bulk, "rollup", lambda star: made.append(1) or rollup(star))
    assert query(star).count() > 0 and len(made) == 1


@pytest.mark.parametrize("hasher", [hashing.mixed, hashing.portable])
def test_a_sample_is_cut_below_the_joins(spark, hasher):
    played = spark.range(3000).selectExpr("if(id % 300 = 7, null, id) AS player_id", "id % 50 AS game_title_id")
    items = spark.range(45).selectExpr("id AS game_title_id", "id % 4 AS category_id")
    known, keys = played.join(items, "game_title_id"), ["player_id", "game_title_id"]
    ranked = ranking.hash_rank(known, keys, 5, hasher=hasher)
    for n in (1, 40, 5000):
        sample = ranking.hash_sample(known, keys, n, 5, hasher)
        text = sample._jdf.queryExecution().optimizedPlan().toString()
        # the rows are cut before they meet the items
        lines = text.splitlines()
        cut = next(i for i, line in enumerate(lines) if "Filter" in line and "scalar-subquery" in line)
        assert any("Join" in line and "game_title_id" in line for line in lines[:cut])
        pick = [*keys, "category_id"]
        assert sorted(map(str, sample.select(pick).collect())) == sorted(map(str, ranked.filter(F.col("hash_rank") <= n).select(pick).collect()))


def test_events_of_a_sample_are_written_once(spark, monkeypatch):
    written, stage = [], training.stage
    monkeypatch.setattr(training, "stage", lambda df, name: written.append(name) or stage(df, name))
    rows = spark.sql("SELECT 1L AS player_id, 2L AS category_id, timestamp_ntz'2024-01-02 00:00:00' AS ref_ts")
    events = spark.sql(
        "SELECT id % 2 AS player_id, if(id % 3 = 0, null, 2L) AS category_id, timestamp_ntz'2024-01-01 12:00:00' "
        "+ make_dt_interval(0, id) AS ts FROM range(24)"
    )
    got = training.recency_as_of(rows, events, "ts").collect()
    assert [r.recent_cat_activity_norm for r in got] == [0.4] and written == ["asked-events"]


def test_features_of_a_category_are_worked_out_before_its_items_are_met(star):
    done = bulk.run(star)
    text = done.candidates._jdf.queryExecution().optimizedPlan().toString()
    lines = text.splitlines()
    met = next(i for i, line in enumerate(lines) if "Join" in line and "category_id" in line)
    above, below = "\n".join(lines[:met]), "\n".join(lines[met:])
    assert "excluded_categories" in below and "excluded_categories" not in above and "recent#" not in above


def test_requests_with_many_categories_are_not_broadcast(spark):
    columns = {k: f"aff_{k}" for k in range(1, 41)}
    market = spark.range(1, 81).selectExpr(
        "'M' AS region_code", "id AS game_title_id", "id % 40 + 1 AS category_id", "'s' AS subvertical", "id AS rounds_30d",
        "0.5D AS ggr_30d_eur", "0.5D AS popularity_trend", "0.5D AS rtp_frac", "cast(NULL AS string) AS market_reason",
    )
    ready = spark.range(1, 11).selectExpr(
        "concat('q', id) AS request_id", "id AS player_id", "'M' AS region_code", "1 AS top_n", "array(id) AS excluded_categories",
        "array('t') AS excluded_subverticals", "map(id, 0.5D) AS affinities", "id AS player_rounds_30d", "map(id, id) AS recent",
    )
    # ten requests would fit, their 400 rows, one for each category, do not
    spread, held = (candidates.assemble(ready, market, columns=columns, max_broadcast_rows=most) for most in (60, 600))
    text = spread._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[[^]]*_salt", text)
    assert sorted(map(str, spread.collect())) == sorted(map(str, held.collect()))
    assert held.count() == 800
