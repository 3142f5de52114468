"""Joins: dimension lookups, existence flags, point-in-time and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions.scalars import before, instant, minute_start, recency_norm
from recloom.operators import joins, trailing
from recloom.plans import candidates, recent
from recloom.plans.eligibility import flag_policies, region_list
from recloom.queries.features import affinity, behavior, profile, rollup
from recloom.queries.registry import query
from recloom.sources.star import DEFAULT_REGION, EVENTS_AS_OF, REGION_PATTERN, ROUNDS_AS_OF, Star


@query(
    "jn1_round_item_category",
    """SELECT c.category_name, c.vertical, count(*) AS rounds, CAST(sum(f.stake) AS DOUBLE) AS stake
       FROM rounds f JOIN items g USING (game_title_id) JOIN categories c USING (category_id) GROUP BY ALL""",
)
def jn1(star: Star) -> DataFrame:
    return (
        star.rounds.join(star.items.select("game_title_id", "category_id"), "game_title_id")
        .join(star.categories, "category_id")
        .groupBy("category_name", "vertical")
        .agg(F.count(F.lit(1)).alias("rounds"), F.sum("stake_total_amt_eur").cast("double").alias("stake"))
    )


@query(
    "jn2_player_left_chain",
    f"""SELECT p.player_id, r.region_code, count(f.ts) AS rounds, count(DISTINCT c.category_id) AS categories
       FROM players p JOIN regions r USING (region_id)
       LEFT JOIN (SELECT * FROM rounds WHERE ts >= TIMESTAMP '{ROUNDS_AS_OF}' - INTERVAL 90 DAY) f USING (player_id)
       LEFT JOIN items g USING (game_title_id) LEFT JOIN categories c ON c.category_id = g.category_id GROUP BY ALL""",
)
def jn2(star: Star) -> DataFrame:
    """Players without rounds in the window keep a row; the rounds are rolled up before they are joined."""
    window = star.rounds.filter(F.col("round_start_timestamp") >= before(ROUNDS_AS_OF, days=90))
    per_category = (
        window.groupBy("player_id", "game_title_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(star.items.select("game_title_id", "category_id"), "game_title_id", "left")
        .groupBy("player_id", "category_id")
        .agg(F.sum("n").alias("n"))
    )
    per_player = per_category.groupBy("player_id").agg(
        F.sum("n").alias("n"), F.count("category_id").alias("categories")
    )
    return (
        star.players.join(star.regions, "region_id")
        .join(per_player, "player_id", "left")
        .select(
            "player_id",
            "region_code",
            F.coalesce("n", F.lit(0)).alias("rounds"),
            F.coalesce("categories", F.lit(0)).alias("categories"),
        )
    )


@query(
    "jn3_items_with_and_without_rounds",
    f"""SELECT g.game_title_id, count(f.ts) AS rounds FROM items g
        LEFT JOIN (SELECT * FROM rounds WHERE ts >= TIMESTAMP '{ROUNDS_AS_OF}' - INTERVAL 60 DAY) f USING (game_title_id)
        GROUP BY ALL""",
)
def jn3(star: Star) -> DataFrame:
    counts = (
        star.rounds.filter(F.col("round_start_timestamp") >= before(ROUNDS_AS_OF, days=60))
        .groupBy("game_title_id")
        .agg(F.count(F.lit(1)).alias("rounds"))
    )
    return (
        star.items.select("game_title_id")
        .join(counts, "game_title_id", "left")
        .withColumn("rounds", F.coalesce("rounds", F.lit(0)))
    )


@query("jn4_market_by_item", "SELECT region_code, game_title_id FROM regions CROSS JOIN items")
def jn4(star: Star) -> DataFrame:
    """Every market with every item: items are expanded in place by the market array."""
    return star.items.select(F.explode(region_list(star.regions)).alias("region_code"), "game_title_id")


@query(
    "jn5_market_policy_flags",
    """SELECT r.region_code, g.game_title_id, b.game_title_id IS NOT NULL AS is_blocked,
              x.category_id IS NOT NULL AS is_market_excluded
       FROM regions r CROSS JOIN items g
       LEFT JOIN market_game_block b ON b.region_code = r.region_code AND b.game_title_id = g.game_title_id
       LEFT JOIN market_category_exclusion x ON x.region_code = r.region_code AND x.category_id = g.category_id""",
)
def jn5(star: Star) -> DataFrame:
    universe = star.items.select("game_title_id", "category_id").withColumn(
        "region_code", F.explode(region_list(star.regions))
    )
    return flag_policies(universe, star.policies).select(
        "region_code", "game_title_id", "is_blocked", "is_market_excluded"
    )


@query(
    "jn6_player_policy_flags",
    """SELECT DISTINCT f.player_id, g.category_id, pc.category_id IS NOT NULL AS is_player_excluded,
              ps.subvertical IS NOT NULL AS is_subvertical_excluded
       FROM rounds f JOIN items g USING (game_title_id) JOIN categories c USING (category_id)
       LEFT JOIN player_category_exclusion pc ON pc.player_id = f.player_id AND pc.category_id = g.category_id
       LEFT JOIN player_subvertical_exclusion ps ON ps.player_id = f.player_id AND ps.subvertical = c.subvertical""",
)
def jn6(star: Star) -> DataFrame:
    pairs = (
        star.rounds.join(star.items.select("game_title_id", "category_id"), "game_title_id")
        .select("player_id", "category_id")
        .distinct()
        .join(star.categories.select("category_id", "subvertical"), "category_id")
    )
    flagged = joins.exists_flag(
        pairs, star.player_category_exclusion, ["player_id", "category_id"], "is_player_excluded"
    )
    flagged = joins.exists_flag(
        flagged, star.player_subvertical_exclusion, ["player_id", "subvertical"], "is_subvertical_excluded"
    )
    return flagged.drop("subvertical")


@query(
    "jn7_single_row_attach",
    "SELECT q.request_id, a.affinity_weight_total, a.aff_promo FROM requests q LEFT JOIN affinity a USING (player_id)",
)
def jn7(star: Star) -> DataFrame:
    """One affinity row per request, as an equi-join on the player."""
    return joins.lookup(
        star.requests, affinity(star), "player_id", {"affinity_weight_total": None, "aff_promo": None}
    ).select("request_id", "affinity_weight_total", "aff_promo")


@query(
    "jn8_scalar_lookup_with_default",
    """SELECT q.request_id, coalesce(b.rounds_30d, 0) AS player_rounds_30d
       FROM requests q LEFT JOIN behavior b USING (player_id)""",
)
def jn8(star: Star) -> DataFrame:
    return joins.lookup(star.requests, behavior(star), "player_id", {"rounds_30d": F.lit(0)}).select(
        "request_id", F.col("rounds_30d").alias("player_rounds_30d")
    )


def plays(star: Star) -> DataFrame:
    return recent.only_plays(star.events)


@query(
    "jn9_recent_interval",
    """SELECT s.event_id, count(e.event_id) AS plays_24h FROM plays s
       LEFT JOIN (SELECT * FROM plays WHERE event_type = 'PLAY') e
         ON e.player_id = s.player_id AND e.category_id = s.category_id
        AND e.event_ts >= s.event_ts - INTERVAL 24 HOUR AND e.event_ts < s.event_ts
       WHERE s.event_type = 'PLAY' GROUP BY s.event_id""",
)
def jn9(star: Star) -> DataFrame:
    """Per play: earlier plays of the same player and category in the 24 h before it."""
    return trailing.trailing(
        plays(star).select("event_id", "player_id", "category_id", "event_ts"),
        plays(star),
        ["player_id", "category_id"],
        "event_ts",
        "event_ts",
        {"24h": 24},
        {"plays": F.lit(1)},
    ).select("event_id", "plays_24h")


@query(
    "ag8_recent_rounds_as_of",
    f"""SELECT f.player_id, g.category_id, count(*) AS plays FROM rounds f JOIN items g USING (game_title_id)
        WHERE f.ts >= TIMESTAMP '2001-06-01 12:00:00' - INTERVAL 24 HOUR AND f.ts < TIMESTAMP '2001-06-01 12:00:00'
        GROUP BY ALL""",
)
def ag8(star: Star) -> DataFrame:
    """Rounds per player and category in the day before a reference time."""
    ref, ts = "2001-06-01 12:00:00", F.col("round_start_timestamp")
    return (
        star.rounds.filter((ts >= before(ref, hours=24)) & (ts < instant(ref)))
        .join(star.items.select("game_title_id", "category_id"), "game_title_id")
        .groupBy("player_id", "category_id")
        .agg(F.count(F.lit(1)).alias("plays"))
    )


@query(
    "ag9_capped_recency_feature",
    """SELECT s.event_id, least(count(e.event_id), 2) / 2.0::DOUBLE AS recent_cat_activity_norm FROM plays s
       LEFT JOIN (SELECT * FROM plays WHERE event_type = 'PLAY') e
         ON e.player_id = s.player_id AND e.category_id = s.category_id
        AND e.event_ts >= s.event_ts - INTERVAL 24 HOUR AND e.event_ts < s.event_ts
       WHERE s.event_type = 'PLAY' GROUP BY s.event_id""",
)
def ag9(star: Star) -> DataFrame:
    """The recency feature with a cap that binds on this data."""
    return jn9(star).select("event_id", recency_norm(F.col("plays_24h"), 2).alias("recent_cat_activity_norm"))


@query(
    "wn9_trailing_24h",
    """SELECT s.event_id, count(e.event_id) AS events_24h, CAST(coalesce(sum(e.stake_amt), 0) AS DOUBLE) AS stake_24h
       FROM plays s LEFT JOIN plays e ON e.player_id = s.player_id
        AND e.event_ts >= s.event_ts - INTERVAL 24 HOUR AND e.event_ts < s.event_ts GROUP BY s.event_id""",
)
def wn9(star: Star) -> DataFrame:
    """Trailing day of every event, whatever its type."""
    return trailing.trailing(
        star.events.select("event_id", "player_id", "event_ts"),
        star.events,
        ["player_id"],
        "event_ts",
        "event_ts",
        {"24h": 24},
        {"events": F.lit(1), "stake": F.col("stake_amt")},
    ).select("event_id", "events_24h", F.col("stake_24h").cast("double").alias("stake_24h"))


@query(
    "wn10_rolling_1h_24h",
    """WITH tiles AS (
         SELECT player_id, date_trunc('minute', event_ts) AS minute, count(*) AS n, sum(stake_amt) AS s
         FROM plays WHERE event_type = 'PLAY' GROUP BY ALL
       ) SELECT a.player_id, a.minute,
           CAST(coalesce(sum(b.n) FILTER (b.minute >= a.minute - INTERVAL 1 HOUR), 0) AS BIGINT) AS plays_1h,
           CAST(coalesce(sum(b.n), 0) AS BIGINT) AS plays_24h,
           CAST(coalesce(sum(b.s) FILTER (b.minute >= a.minute - INTERVAL 1 HOUR), 0) AS DOUBLE) AS stake_1h,
           CAST(coalesce(sum(b.s), 0) AS DOUBLE) AS stake_24h
         FROM tiles a LEFT JOIN tiles b ON b.player_id = a.player_id AND b.minute < a.minute
          AND b.minute >= a.minute - INTERVAL 24 HOUR GROUP BY a.player_id, a.minute""",
)
def wn10(star: Star) -> DataFrame:
    """Rolling plays and stake before every active minute of a player, at one-minute granularity."""
    tiles = recent.minute_tiles(plays(star), ["player_id"])
    rolled = trailing.trailing(
        tiles.select("player_id", "minute"), tiles, ["player_id"], "minute", "minute", recent.WINDOWS,
        {"plays": F.col("plays"), "stake": F.col("stake")},
    )
    return rolled.select(
        "player_id",
        "minute",
        *[F.col(f"plays_{w}").cast("bigint").alias(f"plays_{w}") for w in recent.WINDOWS],
        *[F.col(f"stake_{w}").cast("double").alias(f"stake_{w}") for w in recent.WINDOWS],
    )


@query(
    "jn10_weight_expansion",
    "SELECT p_partkey AS game_title_id, CAST(n AS INTEGER) AS copy FROM part, range(50) t(n) WHERE n < p_size",
)
def jn10(star: Star) -> DataFrame:
    """Each part ``p_size`` times, without a join."""
    return joins.weighted_rows(star.source("part").select("p_partkey", "p_size"), "p_size").select(
        F.col("p_partkey").alias("game_title_id"), "copy"
    )


@query(
    "jn12_feature_tables_inner",
    "SELECT player_id, a.affinity_weight_total, a.aff_small, b.rounds_90d FROM affinity a JOIN behavior b USING (player_id)",
)
def jn12(star: Star) -> DataFrame:
    return (
        affinity(star)
        .join(behavior(star), "player_id")
        .select("player_id", "affinity_weight_total", "aff_small", "rounds_90d")
    )


@query(
    "jn13_candidates_to_block",
    "SELECT game_title_id, game_title FROM items WHERE game_title_id NOT IN (SELECT game_title_id FROM market_game_block)",
)
def jn13(star: Star) -> DataFrame:
    return joins.to_add(
        star.market_game_block, star.items.select("game_title_id", "game_title"), ["game_title_id"]
    )


@query(
    "jn14_ids_of_selected_titles",
    """SELECT game_title_id, game_title FROM items WHERE game_title IN (
         SELECT game_title FROM items JOIN market_game_block USING (game_title_id))""",
)
def jn14(star: Star) -> DataFrame:
    """Titles are not unique: every item of a chosen title is selected."""
    titles = star.items.join(star.market_game_block, "game_title_id").select("game_title")
    return joins.only_selected(star.items, titles, ["game_title"]).select("game_title_id", "game_title")


@query(
    "jn15_as_of_features",
    """WITH view AS (
         SELECT player_id, event_ts, max(category_id) AS category_id, CAST(max(stake_amt) AS DOUBLE) AS stake
         FROM plays WHERE event_type = 'PLAY' GROUP BY player_id, event_ts
       ) SELECT s.event_id, v.category_id AS last_category_id, v.stake AS last_stake
         FROM (SELECT * FROM plays WHERE event_type <> 'PLAY') s
         ASOF LEFT JOIN view v ON v.player_id = s.player_id AND v.event_ts <= s.event_ts""",
)
def jn15(star: Star) -> DataFrame:
    """To every event that is no play: the player's newest play at or before it."""
    view = plays(star).select("player_id", "event_ts", "category_id", F.col("stake_amt").cast("double").alias("stake"))
    spine = star.events.filter(F.col("event_type") != "PLAY").select("event_id", "player_id", "event_ts")
    return trailing.as_of(
        spine, view, ["player_id"], "event_ts", "event_ts", ["category_id", "stake"], "last_"
    ).select("event_id", "last_category_id", "last_stake")


@query(
    "jn16_feature_group",
    f"""WITH activity AS (
         SELECT player_id, count(*) FILTER (event_ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOUR) AS plays_24h,
                count(*) AS plays_72h FROM plays
         WHERE event_type = 'PLAY' AND event_ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 72 HOUR GROUP BY ALL
       ) SELECT b.player_id, b.total_rounds, b.rounds_30d, a.affinity_weight_total, a.aff_large, t.plays_24h, t.plays_72h
         FROM behavior b LEFT JOIN affinity a USING (player_id) LEFT JOIN activity t USING (player_id)""",
)
def jn16(star: Star) -> DataFrame:
    tiles = recent.minute_tiles(plays(star), ["player_id"])
    activity = recent.read_tiles(tiles, ["player_id"], EVENTS_AS_OF, {"24h": 24, "72h": 72})
    return joins.feature_group([behavior(star), affinity(star), activity], "player_id").select(
        "player_id", "total_rounds", "rounds_30d", "affinity_weight_total", "aff_large", "plays_24h", "plays_72h"
    )


@query(
    "jn17_items_like_the_last_played",
    """WITH last_played AS (
         SELECT player_id, game_title_id FROM (SELECT player_id, game_title_id,
           row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, game_title_id DESC) AS rn FROM rounds) WHERE rn = 1
       ) SELECT l.player_id, l.game_title_id AS because_you_played, count(*) AS similar_items,
           max(p.rounds_30d) AS most_rounds
         FROM last_played l JOIN items i ON i.game_title_id = l.game_title_id
         JOIN item_profile p ON p.category_id = i.category_id GROUP BY ALL""",
)
def jn17(star: Star) -> DataFrame:
    """The played item leads to its category, the category to its items (told here as their count and top)."""
    last = trailing.latest(
        star.rounds.select("player_id", "round_start_timestamp", "game_title_id"),
        ["player_id"],
        "round_start_timestamp",
    )
    with_category = last.join(star.items.select("game_title_id", "category_id"), "game_title_id")
    in_category = profile(star).groupBy("category_id").agg(
        F.count(F.lit(1)).alias("similar_items"), F.max("rounds_30d").alias("most_rounds")
    )
    return with_category.join(in_category, "category_id").select(
        "player_id", F.col("game_title_id").alias("because_you_played"), "similar_items", "most_rounds"
    )


@query(
    "pf13_region_resolution",
    "SELECT request_id, region_code FROM resolved",
)
def pf13(star: Star) -> DataFrame:
    return candidates.resolve_requests(
        star.requests, star.players, star.regions, REGION_PATTERN, DEFAULT_REGION
    ).select("request_id", "region_code")


@query(
    "ud1_context_activity",
    """SELECT q.request_id, CAST(coalesce(b.rounds_30d, 0) AS DOUBLE) * q.context_weight AS context_adjusted_activity
       FROM requests q LEFT JOIN behavior b USING (player_id)""",
)
def ud1(star: Star) -> DataFrame:
    return recent.context_activity(star.requests, behavior(star)).select("request_id", "context_adjusted_activity")


@query(
    "wn11_latest_per_key",
    """SELECT player_id, event_ts, event_type FROM (
         SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY event_ts DESC) AS rn FROM plays) WHERE rn = 1""",
)
def wn11(star: Star) -> DataFrame:
    return trailing.latest(star.events.select("player_id", "event_ts", "event_type"), ["player_id"], "event_ts")
