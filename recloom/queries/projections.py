"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions import hashing, scalars
from recloom.operators import joins
from recloom.operators.checks import uniqueness
from recloom.operators.ranking import top_per_group
from recloom.plans import features, rails
from recloom.plans.eligibility import in_market, region_list
from recloom.plans.training import quantile_threshold
from recloom.queries.candidates import CANDIDATES, run
from recloom.queries.features import MODES, affinity, behavior, eligible, profile
from recloom.queries.registry import query
from recloom.sources.star import AFFINITY, EVENTS_AS_OF, Star


@query(
    "pf1_behavior_feature_view",
    MODES
    + """SELECT b.player_id, b.total_rounds, b.distinct_games, b.rounds_7d, b.rounds_30d, b.rounds_90d, b.total_stake_eur,
         b.avg_stake_eur, b.total_ggr_eur, b.days_since_last_play, b.player_segment, pv.vertical AS pref_vertical,
         ps.subvertical AS pref_subvertical, b.region_code,
         coalesce(b.last_activity_ts, TIMESTAMP '2020-01-01 00:00:00') AS last_activity_ts
         FROM behavior b LEFT JOIN pv ON pv.player_id = b.player_id AND pv.rn = 1
         LEFT JOIN ps ON ps.player_id = b.player_id AND ps.rn = 1""",
)
def pf1(star: Star) -> DataFrame:
    return features.behavior_view(behavior(star))


@query(
    "pf2_boolean_to_int",
    """SELECT game_title_id, category_id, vertical, subvertical, CAST(return_to_player_pct AS DOUBLE) AS return_to_player_pct,
       CASE WHEN has_jackpot_yn THEN 1 ELSE 0 END AS has_jackpot, rounds_30d, players_30d, ggr_30d_eur, popularity_trend,
       coalesce(last_played_ts, TIMESTAMP '2020-01-01 00:00:00') AS last_played_ts FROM item_profile""",
)
def pf2(star: Star) -> DataFrame:
    return features.item_view(profile(star))


@query(
    "pf3_available_in_market",
    """SELECT r.region_code, g.game_title_id FROM regions r JOIN items g
       ON g.available_for_play_yn AND (g.is_global_yn OR g.home_region_code = r.region_code)""",
)
def pf3(star: Star) -> DataFrame:
    return (
        star.items.filter("available_for_play_yn")
        .withColumn("region_code", F.explode(region_list(star.regions)))
        .filter(in_market(F.col("region_code")))
        .select("region_code", "game_title_id")
    )


@query(
    "pf4_free_of_policy",
    """SELECT e.region_code, e.game_title_id FROM (
         SELECT r.region_code, g.game_title_id, g.category_id FROM regions r JOIN items g
         ON g.available_for_play_yn AND (g.is_global_yn OR g.home_region_code = r.region_code)) e
       LEFT JOIN market_game_block b ON b.region_code = e.region_code AND b.game_title_id = e.game_title_id
       LEFT JOIN market_category_exclusion x ON x.region_code = e.region_code AND x.category_id = e.category_id
       WHERE b.game_title_id IS NULL AND x.category_id IS NULL""",
)
def pf4(star: Star) -> DataFrame:
    shown = pf3(star).join(star.items.select("game_title_id", "category_id"), "game_title_id")
    return (
        shown.join(star.market_game_block, ["region_code", "game_title_id"], "left_anti")
        .join(star.market_category_exclusion, ["region_code", "category_id"], "left_anti")
        .select("region_code", "game_title_id")
    )


@query(
    "pf5_recent_events",
    f"""SELECT event_id, player_id, event_ts, event_type FROM plays
        WHERE event_ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 2 DAY AND event_ts < TIMESTAMP '{EVENTS_AS_OF}'""",
)
def pf5(star: Star) -> DataFrame:
    ts = F.col("event_ts")
    return star.events.filter(
        (ts >= scalars.before(EVENTS_AS_OF, days=2)) & (ts < scalars.instant(EVENTS_AS_OF))
    ).select("event_id", "player_id", "event_ts", "event_type")


FEATURED = (94, 37, 61)
PERSONAS = (*FEATURED, 1, 2, 3, 5, 8)


@query(
    "pf6_persona_players",
    f"""SELECT player_id, display_name, player_segment, region_code,
        CASE WHEN player_id IN {FEATURED} THEN 0 ELSE 1 END AS priority
        FROM players JOIN regions USING (region_id) WHERE player_id IN {PERSONAS}""",
)
def pf6(star: Star) -> DataFrame:
    priority = F.when(F.col("player_id").isin(*FEATURED), 0).otherwise(1)
    return (
        star.players.filter(F.col("player_id").isin(*PERSONAS))
        .join(star.regions, "region_id")
        .select("player_id", "display_name", "player_segment", "region_code", priority.alias("priority"))
        .orderBy("priority", "player_id")
    )


@query(
    "rc8_demo_players",
    """SELECT player_id, display_name, player_segment, region_code FROM (
         SELECT *, row_number() OVER (PARTITION BY player_segment ORDER BY player_id) AS rn FROM players)
       JOIN regions USING (region_id) WHERE rn <= 3""",
)
def rc8(star: Star) -> DataFrame:
    """A few personas of every segment."""
    return (
        top_per_group(star.players, ["player_segment"], [F.col("player_id")], 3)
        .join(star.regions, "region_id")
        .select("player_id", "display_name", "player_segment", "region_code")
        .orderBy("player_segment", "player_id")
    )


@query(
    "pf7_affinity_of_category",
    """SELECT i.player_id, i.game_title_id,
         coalesce(CASE i.category_id WHEN 1 THEN a.aff_economy WHEN 2 THEN a.aff_large WHEN 3 THEN a.aff_medium
           ELSE a.aff_economy END, 0) AS aff_for_category
       FROM interactions i LEFT JOIN affinity a USING (player_id)""",
)
def pf7(star: Star) -> DataFrame:
    """Look the category up in the wide row; categories without a column use the first."""
    known = {cid: AFFINITY[cid] for cid in (1, 2, 3)}
    shares = affinity(star).select("player_id", features.affinity_map(known).alias("shares"))
    played = features.interactions(
        features.player_item_rollup(star.rounds, "2001-11-05 00:00:00"), star.items
    ).select("player_id", "game_title_id", "category_id")
    return played.join(shares, "player_id", "left").select(
        "player_id",
        "game_title_id",
        F.coalesce(features.affinity_of(F.col("shares"), F.col("category_id"), known), F.lit(0.0)).alias(
            "aff_for_category"
        ),
    )


@query(
    "pf8_ineligible_reason",
    "SELECT region_code, game_title_id, ineligible_reason FROM eligible WHERE ineligible_reason IS NOT NULL",
)
def pf8(star: Star) -> DataFrame:
    return eligible(star).filter("ineligible_reason IS NOT NULL").drop("category_id", "subvertical", "is_eligible")


@query(
    "pf9_suppression_reason",
    CANDIDATES
    + "SELECT request_id, excl_reason, count(*) AS items FROM candidates WHERE excl_reason IS NOT NULL GROUP BY ALL",
)
def pf9(star: Star) -> DataFrame:
    return (
        run(star)
        .candidates.filter("excl_reason IS NOT NULL")
        .groupBy("request_id", "excl_reason")
        .agg(F.count(F.lit(1)).alias("items"))
    )


@query(
    "pf10_kept_and_suppressed",
    CANDIDATES
    + """SELECT request_id, count(*) FILTER (excl_reason IS NULL) AS kept,
         count(*) FILTER (excl_reason IS NOT NULL) AS suppressed FROM candidates GROUP BY request_id""",
)
def pf10(star: Star) -> DataFrame:
    return (
        run(star)
        .candidates.groupBy("request_id")
        .agg(
            F.count_if(F.col("excl_reason").isNull()).alias("kept"),
            F.count_if(F.col("excl_reason").isNotNull()).alias("suppressed"),
        )
    )


@query(
    "pf11_item_detail",
    """SELECT l.player_id, g.game_title_id, g.game_title, g.studio_name, g.tile_image_url, g.tile_color_hex,
         CAST(g.return_to_player_pct AS DOUBLE) AS return_to_player_pct, c.category_id, c.category_name, c.vertical
       FROM (SELECT DISTINCT player_id, game_title_id FROM rounds) l JOIN items g USING (game_title_id)
       JOIN categories c USING (category_id)""",
)
def pf11(star: Star) -> DataFrame:
    """Item details for every (player, item) looked up."""
    asked = star.rounds.select("player_id", "game_title_id").distinct()
    return (
        asked.join(star.items, "game_title_id")
        .join(star.categories, "category_id")
        .select(
            "player_id", "game_title_id", "game_title", "studio_name", "tile_image_url", "tile_color_hex",
            F.col("return_to_player_pct").cast("double").alias("return_to_player_pct"),
            "category_id", "category_name", "vertical",
        )
    )


@query("pf12_active_regions", "SELECT region_code, region_name FROM regions WHERE is_active ORDER BY region_name")
def pf12(star: Star) -> DataFrame:
    return star.regions.filter("is_active").select("region_code", "region_name").orderBy("region_name")


@query(
    "pf14_rail_filter",
    CANDIDATES + "SELECT request_id, rail, rank, game_title_id FROM railed WHERE category_id = 2",
)
def pf14(star: Star) -> DataFrame:
    return run(star).rails.filter("category_id = 2").select("request_id", "rail", "rank", "game_title_id")


@query(
    "pf15_cards",
    CANDIDATES
    + """SELECT r.request_id, r.rail, r.rank, r.game_title_id, g.game_title AS title, g.studio_name AS studio,
           c.category_name AS category, r.category_id, c.vertical, g.tile_image_url AS tile_url,
           g.tile_color_hex AS tile_color, r.boosted, r.trend_score,
           CAST((q + CASE WHEN x - q > 0.5 OR (x - q = 0.5 AND q % 2 = 1) THEN 1 ELSE 0 END) AS DOUBLE) / 10000 AS score
         FROM (SELECT *, floor(x) AS q FROM (
           SELECT *, CAST(CAST(score AS VARCHAR) AS DECIMAL(30,20)) * 10000 AS x FROM railed)) r JOIN items g USING (game_title_id) JOIN categories c ON c.category_id = r.category_id""",
)
def pf15(star: Star) -> DataFrame:
    return rails.cards(run(star).rails, star.items, star.categories).drop(
        "player_id", "region_code", "model_score", "match_pct"
    )


@query(
    "pf16_match_percent",
    CANDIDATES
    + """SELECT request_id, rail, rank,
           CAST(least(100, greatest(0, floor(score * 100 + 0.5))) AS INTEGER) AS match_pct FROM railed""",
)
def pf16(star: Star) -> DataFrame:
    return run(star).rails.select("request_id", "rail", "rank", scalars.match_percent(F.col("score")).alias("match_pct"))


@query(
    "sf1_arithmetic",
    """SELECT p_partkey, greatest(p_size, 10) AS g, least(p_size, 10) AS l, abs(p_size - 25) AS a,
       power(CAST(p_size AS DOUBLE) / 64, 2) AS p, CAST(floor(p_retailprice) AS BIGINT) AS f, p_size % 7 AS m,
       CAST(round(p_size / 8.0::DOUBLE, 0) AS INTEGER) AS r FROM part""",
)
def sf1(star: Star) -> DataFrame:
    size = F.col("p_size")
    return star.source("part").select(
        "p_partkey",
        F.greatest(size, F.lit(10)).alias("g"),
        F.least(size, F.lit(10)).alias("l"),
        F.abs(size - 25).alias("a"),
        F.pow(size / F.lit(64.0), F.lit(2)).alias("p"),
        F.floor("p_retailprice").alias("f"),
        F.pmod(size, F.lit(7)).alias("m"),
        F.round(size / F.lit(8.0), 0).cast("int").alias("r"),
    )


@query(
    "sf2_null_and_zero",
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) / (p_size % 5) END AS div0,
       nullif(p_size, 50) AS without_50, coalesce(nullif(p_size, 50), 0) AS zeroed,
       CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS word FROM part""",
)
def sf2(star: Star) -> DataFrame:
    size = F.col("p_size")
    without = F.nullif(size, F.lit(50))
    return star.source("part").select(
        "p_partkey",
        scalars.div0(size, size % 5).alias("div0"),
        without.alias("without_50"),
        scalars.zero_if_null(without).alias("zeroed"),
        F.when(size > 25, "big").otherwise("small").alias("word"),
    )


@query(
    "sf3_dates",
    """SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS due, CAST(o_orderdate AS DATE) AS day,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-11-05') AS INTEGER) AS age_days,
       o_orderdate >= TIMESTAMP '2001-11-05 00:00:00' - INTERVAL 365 DAY AS is_recent FROM orders""",
)
def sf3(star: Star) -> DataFrame:
    ts = F.col("o_orderdate")
    return star.source("orders").select(
        "o_orderkey",
        (ts + F.expr("INTERVAL 30 DAYS")).alias("due"),
        F.to_date(ts).alias("day"),
        F.datediff(F.lit("2001-11-05").cast("date"), F.to_date(ts)).alias("age_days"),
        (ts >= scalars.before("2001-11-05 00:00:00", days=365)).alias("is_recent"),
    )


@query(
    "sf4_text",
    """SELECT p_partkey, 'PC' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS code, lower(p_brand) AS brand,
       replace(p_name, ' ', '-') AS dashed FROM part""",
)
def sf4(star: Star) -> DataFrame:
    return star.source("part").select(
        "p_partkey",
        scalars.padded_code("PC", F.col("p_partkey"), 7).alias("code"),
        F.lower("p_brand").alias("brand"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("dashed"),
    )


@query("sf5_email_hash", "SELECT c_custkey, sha256(c_name || '@example.org') AS email_hash FROM customer")
def sf5(star: Star) -> DataFrame:
    return star.source("customer").select(
        "c_custkey", scalars.email_hash(F.concat("c_name", F.lit("@example.org"))).alias("email_hash")
    )


@query(
    "sf6_daily_session",
    f"""SELECT DISTINCT player_id, round_date,
        {hashing.portable_sql(["player_id", "date_diff('day', DATE '1970-01-01', round_date)"], 0)} % 1000000000 AS session_id
        FROM rounds""",
)
def sf6(star: Star) -> DataFrame:
    session = scalars.daily_session(F.col("player_id"), F.col("round_date"), hashing.portable)
    return star.rounds.select("player_id", "round_date").distinct().withColumn("session_id", session)


WORDS = ["WEB", "APP", "STORE", "MAIL", "PARTNER"]


@query(
    "sf7_array_pick",
    f"SELECT c_custkey, ({WORDS})[CAST(c_custkey % 5 AS INTEGER) + 1] AS channel FROM customer",
)
def sf7(star: Star) -> DataFrame:
    return star.source("customer").select("c_custkey", scalars.pick(WORDS, F.col("c_custkey")).alias("channel"))


@query("sf8_array_size", "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS words FROM part")
def sf8(star: Star) -> DataFrame:
    return star.source("part").select("p_partkey", F.size(F.split("p_name", " ")).alias("words"))


@query("sf9_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def sf9(star: Star) -> DataFrame:
    return star.source("events").select(
        "event_id", F.variant_get(F.parse_json("props"), "$.k", "double").alias("k")
    )


@query("sf10_parse_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def sf10(star: Star) -> DataFrame:
    return star.source("events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query(
    "sf11_json_array_rows",
    """SELECT k, count(*) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
       UNION ALL SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'view') GROUP BY k""",
)
def sf11(star: Star) -> DataFrame:
    """Views carry their properties twice in a JSON array; every element becomes a row."""
    doubled = F.when(F.col("event_type") == "view", F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]")))
    listed = F.coalesce(doubled, F.concat(F.lit("["), "props", F.lit("]")))
    return (
        star.source("events")
        .select(F.explode(F.from_json(listed, "ARRAY<STRUCT<k: BIGINT>>")).alias("e"))
        .groupBy(F.col("e.k").alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "sf12_parallel_arrays",
    "SELECT player_id, category_id, count(*) AS plays FROM plays WHERE event_type = 'PLAY' GROUP BY ALL",
)
def sf12(star: Star) -> DataFrame:
    """Per player two parallel arrays (keys, counts; at most one entry per category), read back as a map."""
    counts = (
        star.events.filter("event_type = 'PLAY'")
        .groupBy("player_id", "category_id")
        .agg(F.count(F.lit(1)).alias("plays"))
    )
    pairs = counts.groupBy("player_id").agg(
        F.sort_array(F.collect_list(F.struct("category_id", "plays"))).alias("pairs")
    )
    arrays = pairs.select("player_id", F.col("pairs.category_id").alias("keys"), F.col("pairs.plays").alias("counts"))
    return arrays.select("player_id", F.explode(F.map_from_arrays("keys", "counts")).alias("category_id", "plays"))


@query(
    "sf13_stable_keys",
    "SELECT o_orderkey, sha256(o_orderkey || '|' || o_custkey) AS row_key FROM orders",
)
def sf13(star: Star) -> DataFrame:
    return star.source("orders").select(
        "o_orderkey", scalars.stable_uuid(F.col("o_orderkey"), F.col("o_custkey")).alias("row_key")
    )


@query(
    "sf14_regex_match",
    "SELECT n_nationkey, regexp_full_match(n_name, '[A-Z]+_1?[0-9]') AS matches FROM nation",
)
def sf14(star: Star) -> DataFrame:
    return star.source("nation").select("n_nationkey", F.col("n_name").rlike("^[A-Z]+_1?[0-9]$").alias("matches"))


@query("sf15_local_part", "SELECT c_custkey, split_part(c_name || '@example.org', '@', 1) AS name FROM customer")
def sf15(star: Star) -> DataFrame:
    return star.source("customer").select(
        "c_custkey", scalars.local_part(F.concat("c_name", F.lit("@example.org"))).alias("name")
    )


@query(
    "sf16_slugs",
    """SELECT p_partkey, lower(replace(p_name, ' ', '-')) || '-' || p_partkey AS slug,
       regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS long_slug
       FROM part""",
)
def sf16(star: Star) -> DataFrame:
    return star.source("part").select(
        "p_partkey",
        scalars.slug(F.col("p_name"), F.col("p_partkey")).alias("slug"),
        scalars.clean_slug(F.concat_ws(" ", "p_brand", "p_name")).alias("long_slug"),
    )


@query(
    "sf17_fill_features",
    "SELECT game_title_id, coalesce(CAST(nullif(rounds_30d, 0) AS DOUBLE), 0.0) AS filled FROM item_profile",
)
def sf17(star: Star) -> DataFrame:
    return profile(star).select(
        "game_title_id", scalars.fill_feature(F.nullif(F.col("rounds_30d"), F.lit(0))).alias("filled")
    )


@query(
    "ag14_never_played",
    """SELECT p.player_id, g.category_id, count(*) AS unplayed FROM players p CROSS JOIN items g
       LEFT JOIN interactions i ON i.player_id = p.player_id AND i.game_title_id = g.game_title_id
       WHERE i.player_id IS NULL GROUP BY ALL""",
)
def ag14(star: Star) -> DataFrame:
    """Items a player has not played, per category: category size minus played items, no player x item pairs."""
    sizes = star.items.groupBy("category_id").agg(F.count(F.lit(1)).alias("size"))
    listed = sizes.agg(F.collect_list(F.struct("category_id", "size"))).scalar()
    played = (
        star.rounds.select("player_id", "game_title_id")
        .distinct()
        .join(star.items.select("game_title_id", "category_id"), "game_title_id")
        .groupBy("player_id", "category_id")
        .agg(F.count(F.lit(1)).alias("played"))
    )
    return (
        star.players.select("player_id", F.explode(listed).alias("c"))
        .select("player_id", "c.category_id", "c.size")
        .join(played, ["player_id", "category_id"], "left")
        .select("player_id", "category_id", (F.col("size") - F.coalesce("played", F.lit(0))).alias("unplayed"))
        .filter("unplayed > 0")
    )


@query(
    "ag15_global_max",
    """SELECT game_title_id, CAST(rounds_30d AS DOUBLE) / (SELECT max(rounds_30d) FROM item_profile) AS norm,
       (SELECT max(game_title_id) + 1 FROM items) AS next_id FROM item_profile""",
)
def ag15(star: Star) -> DataFrame:
    played = profile(star)
    return played.select(
        "game_title_id",
        scalars.ratio(F.col("rounds_30d"), played.agg(F.max("rounds_30d")).scalar()).alias("norm"),
        (star.items.agg(F.max("game_title_id")).scalar() + 1).alias("next_id"),
    )


@query(
    "ag17_segment_skew",
    """SELECT CAST(sum(CASE WHEN b.player_segment = 'BUILDING' THEN CAST(a.aff_promo AS DECIMAL(28,18)) END) AS DOUBLE)
              / count(*) FILTER (b.player_segment = 'BUILDING') AS promo_inside,
            CAST(sum(CASE WHEN b.player_segment <> 'BUILDING' THEN CAST(a.aff_promo AS DECIMAL(28,18)) END) AS DOUBLE)
              / count(*) FILTER (b.player_segment <> 'BUILDING') AS promo_outside
       FROM affinity a JOIN behavior b USING (player_id)""",
)
def ag17(star: Star) -> DataFrame:
    return features.affinity_by_segment(affinity(star), behavior(star), "BUILDING", {"promo": "aff_promo"})


@query(
    "ag18_title_uniqueness",
    "SELECT count(*) AS rows, count(DISTINCT game_title) AS distinct_values, count(*) = count(DISTINCT game_title) AS is_unique FROM items",
)
def ag18(star: Star) -> DataFrame:
    return uniqueness(star.items, "game_title")


@query(
    "ag16_quantile_threshold",
    """SELECT quantile_cont(rounds_90d, 0.65) AS threshold,
       count(*) FILTER (rounds_90d > (SELECT quantile_cont(rounds_90d, 0.65) FROM behavior)) AS above FROM behavior""",
)
def ag16(star: Star) -> DataFrame:
    activity = behavior(star).select("rounds_90d")
    threshold = quantile_threshold(activity, "rounds_90d", 0.65)
    return activity.agg(
        F.max(threshold.scalar()).alias("threshold"),
        F.count_if(F.col("rounds_90d") > threshold.scalar()).alias("above"),
    )


@query("so1_distinct_subverticals", "SELECT DISTINCT subvertical FROM categories JOIN items USING (category_id)")
def so1(star: Star) -> DataFrame:
    return joins.only_selected(star.categories, star.items, ["category_id"]).select("subvertical").distinct()
