"""Batch feature tables and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions.scalars import before, instant
from recloom.plans import eligibility, features, rails
from recloom.queries.registry import query
from recloom.sources.star import AFFINITY, EVENTS_AS_OF, ROUNDS_AS_OF, Star


def rollup(star: Star) -> DataFrame:
    return features.player_item_rollup(star.rounds, ROUNDS_AS_OF)


def behavior(star: Star) -> DataFrame:
    return features.player_behavior(
        rollup(star), star.players, star.regions, star.items, star.categories, ROUNDS_AS_OF
    )


def affinity(star: Star) -> DataFrame:
    return features.player_affinity(rollup(star), star.items, star.categories, AFFINITY)


def profile(star: Star) -> DataFrame:
    return features.item_profile(rollup(star), star.items, star.categories)


def eligible(star: Star) -> DataFrame:
    return eligibility.market_eligible(star.regions, star.items, star.categories, star.policies)


MODES = """
WITH kinds AS (
  SELECT f.player_id, c.vertical, c.subvertical FROM past f LEFT JOIN items g USING (game_title_id)
  LEFT JOIN categories c USING (category_id)
), pv AS (
  SELECT player_id, vertical, row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, vertical) AS rn
  FROM kinds GROUP BY player_id, vertical
), ps AS (
  SELECT player_id, subvertical, row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, subvertical) AS rn
  FROM kinds GROUP BY player_id, subvertical
)
"""


@query(
    "ag1_player_behavior",
    MODES
    + """SELECT b.*, pv.vertical AS pref_vertical, ps.subvertical AS pref_subvertical FROM behavior b
  LEFT JOIN pv ON pv.player_id = b.player_id AND pv.rn = 1 LEFT JOIN ps ON ps.player_id = b.player_id AND ps.rn = 1""",
)
def ag1(star: Star) -> DataFrame:
    return behavior(star)


@query("ag2_player_affinity", "SELECT * FROM affinity")
def ag2(star: Star) -> DataFrame:
    return affinity(star)


@query(
    "ag3_item_profile",
    """SELECT p.* REPLACE (CAST(p.return_to_player_pct AS DOUBLE) AS return_to_player_pct),
       i.is_global_yn, i.home_region_code, i.tile_image_url, i.tile_color_hex
       FROM item_profile p JOIN items i USING (game_title_id)""",
)
def ag3(star: Star) -> DataFrame:
    return profile(star).withColumn("return_to_player_pct", F.col("return_to_player_pct").cast("double"))


@query("ag4_interactions", "SELECT * FROM interactions")
def ag4(star: Star) -> DataFrame:
    return features.interactions(rollup(star), star.items)


@query(
    "ag5_affinity_long",
    """SELECT a.player_id, c.category_id, coalesce(l.affinity, 0.0) AS affinity
       FROM affinity a CROSS JOIN categories c
       LEFT JOIN affinity_long l ON l.player_id = a.player_id AND l.category_id = c.category_id""",
)
def ag5(star: Star) -> DataFrame:
    return features.affinity_long(affinity(star), AFFINITY)


@query(
    "ag6_conditional_distinct",
    f"""SELECT game_title_id, count(DISTINCT CASE WHEN ts >= TIMESTAMP '{ROUNDS_AS_OF}' - INTERVAL 90 DAY
        THEN player_id END) AS players_90d FROM past GROUP BY game_title_id""",
)
def ag6(star: Star) -> DataFrame:
    recent = F.col("round_start_timestamp") >= before(ROUNDS_AS_OF, days=90)
    return (
        star.rounds.filter(F.col("round_start_timestamp") < instant(ROUNDS_AS_OF))
        .groupBy("game_title_id")
        .agg(F.count_distinct(F.when(recent, F.col("player_id"))).alias("players_90d"))
    )


def recent_plays(star: Star) -> DataFrame:
    """Plays per player and category over the last 24 h of the raw events."""
    ts = F.col("event_ts")
    return (
        star.events.filter(
            (F.col("event_type") == "PLAY")
            & F.col("category_id").isNotNull()
            & (ts >= before(EVENTS_AS_OF, hours=48))
            & (ts < instant(EVENTS_AS_OF))
        )
        .groupBy("player_id", "category_id")
        .agg(F.count(F.lit(1)).alias("plays"))
    )


@query(
    "ag7_recent_category_plays",
    f"""SELECT player_id, category_id, count(*) AS plays FROM plays
        WHERE event_type = 'PLAY' AND category_id IS NOT NULL AND event_ts < TIMESTAMP '{EVENTS_AS_OF}'
          AND event_ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 48 HOUR GROUP BY ALL""",
)
def ag7(star: Star) -> DataFrame:
    return recent_plays(star)


@query(
    "ag10_eligible_counts",
    "SELECT region_code, is_eligible, count(*) AS game_count FROM eligible GROUP BY ALL",
)
def ag10(star: Star) -> DataFrame:
    return eligible(star).groupBy("region_code", "is_eligible").agg(F.count(F.lit(1)).alias("game_count"))


@query(
    "ag11_ineligible_reasons",
    """SELECT region_code, ineligible_reason, count(*) AS game_count FROM eligible
       WHERE is_eligible = FALSE AND ineligible_reason IS NOT NULL GROUP BY ALL""",
)
def ag11(star: Star) -> DataFrame:
    return (
        eligible(star)
        .filter((~F.col("is_eligible")) & F.col("ineligible_reason").isNotNull())
        .groupBy("region_code", "ineligible_reason")
        .agg(F.count(F.lit(1)).alias("game_count"))
        .orderBy("region_code", F.desc("game_count"), "ineligible_reason")
    )


@query("rc1_market_eligible", "SELECT * FROM eligible")
def rc1(star: Star) -> DataFrame:
    return eligible(star)


@query(
    "sl2_trending_rail",
    """WITH ranked AS (
         SELECT e.region_code, e.game_title_id, p.rounds_30d,
                row_number() OVER (PARTITION BY e.region_code ORDER BY p.rounds_30d DESC, e.game_title_id) AS rank
         FROM eligible e JOIN item_profile p USING (game_title_id) WHERE e.is_eligible
       ) SELECT region_code, rank, game_title_id, rounds_30d,
           CAST(round_even(100 * (CAST(rounds_30d AS DOUBLE)
             / greatest(1, max(rounds_30d) OVER (PARTITION BY region_code))), 0) AS INTEGER) AS trend_score
         FROM ranked WHERE rank <= 12""",
)
def sl2(star: Star) -> DataFrame:
    return rails.trending_in_market(eligible(star), profile(star), 12)
