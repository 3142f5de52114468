"""Backdated requests cover all active players."""

from pyspark.sql import functions as F

from recloom.operators.trailing import of_spine
from recloom.plans import monitor


def test_every_active_player_is_logged(spark):
    players = spark.range(500).selectExpr("id AS player_id", "id % 2 AS region_id", "id % 5 > 0 AS is_active")
    regions = spark.createDataFrame([(0, "A"), (1, "B")], "region_id long, region_code string")
    rows = monitor.backfill_requests(players, regions, "2024-01-10 00:00:00").collect()
    assert sorted(r.player_id for r in rows) == [i for i in range(500) if i % 5]
    assert {r.slot for r in rows} == set(range(7)) and len({r.request_id for r in rows}) == 400
    cut = monitor.backfill_requests(players, regions, "2024-01-10 00:00:00", per_region=2)
    assert cut.count() == 2 * 2 * 7


def test_recent_rounds_of_few_and_many_players(spark, monkeypatch):
    """Windows are half-open; rounds of others, out of the span of all windows or without a key count nowhere."""
    asked = spark.sql(
        "SELECT concat('q', id) AS request_id, id AS player_id, timestamp_ntz'2024-01-05 00:00:00' "
        "+ make_dt_interval(id % 3, id % 5) AS ref_ts FROM range(40)"
    )
    rounds = spark.sql(
        "SELECT if(id % 53 = 0, null, id % 60) AS player_id, id % 7 AS game_title_id, if(id % 41 = 0, null, "
        "timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, id % 150)) AS round_start_timestamp FROM range(9000)"
    )
    items = spark.range(6).selectExpr("id AS game_title_id", "id % 3 AS category_id")
    categories = spark.range(3).selectExpr("id AS category_id")
    r, q = rounds.alias("r").join(items, "game_title_id"), asked.alias("q")
    inside = "r.player_id = q.player_id AND r.round_start_timestamp < q.ref_ts AND r.round_start_timestamp >= q.ref_ts - INTERVAL 24 HOUR"
    want = q.join(r, F.expr(inside)).groupBy("request_id", "category_id").count()
    want = sorted(tuple(x) for x in want.collect())
    read, stage = {}, monitor.stage
    monkeypatch.setattr(
        monitor, "stage", lambda df, name: read.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or stage(df, name)
    )
    for most in (40, 39):
        monkeypatch.setitem(of_spine.__globals__, "fits_broadcast", lambda df, _, most=most: df.count() <= most)
        read.clear()
        got = monitor.recent_before(asked, rounds, items, categories)
        assert "scalar-subquery" in read["asked-rounds"] and ("LeftSemi" in read["asked-rounds"]) == (most == 40)
        assert sorted(tuple(x)[:3] for x in got.collect()) == want and want
    assert monitor.recent_before(asked.limit(0), rounds, items, categories).count() == 0


def test_first_logged_day_needs_no_candidates(spark):
    """Requests whose every item is barred, or whose market shows none, have no rows and so no day."""
    market = spark.createDataFrame(
        [("A", 1, "one", 1, None), ("A", 2, "two", 2, None), ("A", 3, "three", 3, "MARKET_GAME_BLOCK"), ("C", 1, "one", 1, "MARKET_GAME_BLOCK"),
         ("D", 4, None, 7, None)],
        "region_code string, category_id long, subvertical string, game_title_id long, market_reason string",
    )
    rows = [
        ("barred", "A", [1], ["two"], 1), ("blocked", "C", [], [], 2), ("elsewhere", "B", [], [], 3),
        ("lost", None, [], [], 3), ("kept", "A", [1], ["one"], 5), ("late", "A", [], [], 6), ("unnamed", "D", [1], ["two"], 4),
    ]
    ready = spark.createDataFrame(
        rows, "request_id string, region_code string, excluded_categories array<long>, excluded_subverticals array<string>, day int"
    ).selectExpr("*", "timestamp_ntz'2024-01-01 07:00:00' + make_dt_interval(day) AS ref_ts")
    first = lambda df: str(spark.range(1).select(monitor.first_logged(df, market)).first()[0])
    assert first(ready) == "2024-01-05 00:00:00"
    assert first(ready.filter("region_code <> 'D'")) == "2024-01-06 00:00:00"
    assert first(ready.filter("day < 4")) == "None"


def test_baseline_of_a_backfill_expands_the_first_day_only(spark):
    from recloom.queries import monitoring
    from recloom.sources.star import Star
    from tests.conftest import SF_DIR

    log, first = monitoring.backfill(Star(spark, SF_DIR), None)
    log = log.withColumn("event_ts", F.col("ref_ts"))
    day = monitor.baseline(log, ["row_id"], first=first)
    wanted = monitor.baseline(log, ["row_id"])
    assert day.count() == wanted.count() > 0 and day.exceptAll(wanted).count() == 0
    plan = day._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rounds_30d") and "rtp_frac" not in first._jc.toString()
    meets = [n for n, line in enumerate(plan.splitlines()) if "Join Inner" in line and "category_id" in line]
    picks = [n for n, line in enumerate(plan.splitlines()) if "date_trunc" in line and "Filter" in line]
    assert meets and picks and min(picks) > min(meets)  # the day is picked below the join with the items
