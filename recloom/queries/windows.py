"""Ranks, top-k, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions import hashing, scalars
from recloom.operators import policy, ranking, sampling
from recloom.plans import rails, traces
from recloom.plans.features import interactions
from recloom.queries.candidates import CANDIDATES, run
from recloom.queries.features import eligible, profile, rollup
from recloom.queries.registry import query
from recloom.sources.star import CATEGORY_ROWS, Star
from recloom.sources.tables import values

ITEM_HASH = hashing.portable_sql(["game_title_id"], 7)


@query(
    "wn1_market_normaliser",
    """SELECT e.region_code, e.game_title_id,
         CAST(p.rounds_30d AS DOUBLE) / nullif(max(p.rounds_30d) OVER (PARTITION BY e.region_code), 0) AS norm
       FROM eligible e JOIN item_profile p USING (game_title_id) WHERE e.is_eligible""",
)
def wn1(star: Star) -> DataFrame:
    """The top of each market is aggregated and joined back: a market is never one window task."""
    shown = (
        eligible(star)
        .filter("is_eligible")
        .select("region_code", "game_title_id")
        .join(profile(star).select("game_title_id", "rounds_30d"), "game_title_id")
    )
    top = shown.groupBy("region_code").agg(F.max("rounds_30d").alias("most"))
    return shown.join(top, "region_code").select(
        "region_code", "game_title_id", scalars.ratio(F.col("rounds_30d"), F.col("most")).alias("norm")
    )


@query(
    "wn2_first_players_per_region",
    """SELECT region_code, player_id, rn FROM (
         SELECT region_code, player_id, row_number() OVER (PARTITION BY region_code ORDER BY player_id) AS rn
         FROM players JOIN regions USING (region_id) WHERE players.is_active) WHERE rn <= 14""",
)
def wn2(star: Star) -> DataFrame:
    active = star.players.filter("is_active").join(star.regions.select("region_id", "region_code"), "region_id")
    return ranking.top_per_group(
        active.select("region_code", "player_id"), ["region_code"], [F.col("player_id")], 14, "rn"
    )


@query(
    "wn3_rank_in_category",
    """SELECT game_title_id, category_id, row_number() OVER (PARTITION BY category_id ORDER BY game_title_id) - 1 AS nth
       FROM items""",
)
def wn3(star: Star) -> DataFrame:
    items = star.items.select("game_title_id", "category_id")
    return ranking.number_rank(items, "game_title_id", ["category_id"]).select(
        "game_title_id", "category_id", (F.col("rank") - 1).alias("nth")
    )


@query(
    "wn4_rank_by_expression",
    """SELECT game_title_id, vertical, row_number() OVER (PARTITION BY (vertical = 'size') ORDER BY game_title_id) - 1 AS nth
       FROM items JOIN categories USING (category_id)""",
)
def wn4(star: Star) -> DataFrame:
    items = star.items.join(star.categories, "category_id").select("game_title_id", "vertical")
    split = items.withColumn("is_size", F.col("vertical") == "size")
    return ranking.number_rank(split, "game_title_id", ["is_size"]).select(
        "game_title_id", "vertical", (F.col("rank") - 1).alias("nth")
    )


@query(
    "wn5_shuffled_rank",
    f"""SELECT game_title_id, category_id,
        row_number() OVER (PARTITION BY category_id ORDER BY {ITEM_HASH}, game_title_id) AS hash_rank FROM items""",
)
def wn5(star: Star) -> DataFrame:
    return ranking.hash_rank(
        star.items.select("game_title_id", "category_id"), ["game_title_id"], 7, ["category_id"], hasher=hashing.portable
    )


@query(
    "wn6_diversified_topn",
    CANDIDATES + "SELECT request_id, rank, game_title_id, category_id, score FROM recommended",
)
def wn6(star: Star) -> DataFrame:
    """Every candidate is scored; those that no rail can take are left out before they are sorted."""
    done = run(star, item_part=None)
    return rails.diversify(done.ranked, 12).select("request_id", "rank", "game_title_id", "category_id", "score")


@query(
    "wn7_rank_in_rail",
    CANDIDATES + "SELECT request_id, rail, max(rank) AS last_rank, count(*) AS shown FROM railed GROUP BY ALL",
)
def wn7(star: Star) -> DataFrame:
    return (
        run(star)
        .rails.groupBy("request_id", "rail")
        .agg(F.max("rank").cast("bigint").alias("last_rank"), F.count(F.lit(1)).alias("shown"))
    )


def latencies(star: Star) -> DataFrame:
    """Stage durations per event, made of its number ``k``."""
    k = F.get_json_object("props", "$.k").cast("double")
    return star.source("events").select(
        F.col("event_id").alias("trace_id"),
        k.alias("resolve"),
        F.when(k % 11 != 0, k % 7).alias("recent_activity"),
        (k * 0.5).alias("assemble"),
        (k % 13 * 0.25).alias("rank"),
        (k * 2).alias("total"),
    )


@query(
    "wn8_latency_waterfall",
    """WITH l AS (
         SELECT event_id AS trace_id, k AS a, CASE WHEN k % 11 <> 0 THEN k % 7 ELSE 0 END AS b, k * 0.5::DOUBLE AS c,
                (k % 13) * 0.25::DOUBLE AS d, k * 2 AS total
         FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
       ), s AS (
         SELECT *, CASE WHEN greatest(total, a + b + c + d) = 0 THEN 1 ELSE greatest(total, a + b + c + d) END AS span,
                greatest(total - (a + b + c + d), 0) AS overhead_ms FROM l
       ) SELECT trace_id, 0 AS position, 'resolve' AS stage, a AS ms, 0.0::DOUBLE / span * 100 AS offset_pct,
                greatest(a / span * 100, 0.6::DOUBLE) AS width_pct, overhead_ms FROM s
         UNION ALL SELECT trace_id, 1, 'recent_activity', b, a / span * 100, greatest(b / span * 100, 0.6::DOUBLE), overhead_ms FROM s
         UNION ALL SELECT trace_id, 2, 'assemble', c, (a + b) / span * 100, greatest(c / span * 100, 0.6::DOUBLE), overhead_ms FROM s
         UNION ALL SELECT trace_id, 3, 'rank', d, (a + b + c) / span * 100, greatest(d / span * 100, 0.6::DOUBLE), overhead_ms FROM s""",
)
def wn8(star: Star) -> DataFrame:
    return traces.waterfall(latencies(star))


@query(
    "sl1_recommended_rail",
    CANDIDATES + "SELECT request_id, rank, game_title_id FROM railed WHERE rail = 'recommended_for_you'",
)
def sl1(star: Star) -> DataFrame:
    return run(star).rails.filter(F.col("rail") == rails.RECOMMENDED).select("request_id", "rank", "game_title_id")


@query(
    "sl3_because_you_played_rail",
    CANDIDATES + "SELECT request_id, rank, game_title_id, score FROM railed WHERE rail = 'because_you_played'",
)
def sl3(star: Star) -> DataFrame:
    return (
        run(star).rails.filter(F.col("rail") == rails.SIMILAR).select("request_id", "rank", "game_title_id", "score")
    )


@query(
    "sl4_latest_per_player",
    """SELECT player_id, event_id, event_ts, rn FROM (
         SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY event_ts DESC, event_id) AS rn FROM plays) WHERE rn <= 8""",
)
def sl4(star: Star) -> DataFrame:
    return ranking.top_per_group(
        star.events.select("player_id", "event_id", "event_ts"),
        ["player_id"],
        [F.desc("event_ts"), F.col("event_id")],
        max(1, min(8, 25)),
        "rn",
    )


@query("sl5_sorted_titles", "SELECT game_title_id, category_id, game_title, studio_name FROM items ORDER BY game_title")
def sl5(star: Star) -> DataFrame:
    return star.items.select("game_title_id", "category_id", "game_title", "studio_name").orderBy(
        "game_title", "game_title_id"
    )


@query(
    "sl6_catalogue_order",
    "SELECT vertical, category_id, game_title_id FROM items JOIN categories USING (category_id) ORDER BY ALL",
)
def sl6(star: Star) -> DataFrame:
    return (
        star.items.join(star.categories, "category_id")
        .select("vertical", "category_id", "game_title_id")
        .orderBy("vertical", "category_id", "game_title_id")
    )


PAIR_HASH = hashing.portable_sql(["player_id", "game_title_id"], 42)


@query(
    "sl7_fixed_size_sample",
    f"SELECT player_id, game_title_id, play_count FROM interactions ORDER BY {PAIR_HASH}, player_id, game_title_id LIMIT 6000",
)
def sl7(star: Star) -> DataFrame:
    pairs = interactions(rollup(star), star.items).select("player_id", "game_title_id", "play_count")
    return ranking.hash_sample(pairs, ["player_id", "game_title_id"], 6_000, hasher=hashing.portable)


@query(
    "sl8_shuffle_and_cap",
    f"SELECT event_id, event_ts FROM plays ORDER BY {hashing.portable_sql(['event_id'], 42)}, event_id LIMIT 3000",
)
def sl8(star: Star) -> DataFrame:
    numbered = star.events.select(F.col("event_id").cast("bigint").alias("id"), "event_id", "event_ts")
    return ranking.hash_sample(numbered, ["id"], 3_000, hasher=hashing.portable).drop("id")


@query(
    "so2_union_of_rails",
    CANDIDATES
    + """SELECT rail, category_id, count(*) AS shown FROM railed GROUP BY ALL""",
)
def so2(star: Star) -> DataFrame:
    return run(star).rails.groupBy("rail", "category_id").agg(F.count(F.lit(1)).alias("shown"))


@query(
    "so3_policy_diff",
    """WITH old AS (SELECT region_code, game_title_id, reason FROM market_game_block),
       new AS (SELECT 'EUROPE' AS region_code, p_partkey AS game_title_id,
                 CASE WHEN p_partkey % 5 = 0 THEN 'reviewed' ELSE 'regulatory restriction' END AS reason
               FROM part WHERE p_partkey % 97 = 0 AND p_partkey % 2 = 0 OR p_partkey % 101 = 0)
       SELECT coalesce(o.region_code, n.region_code) AS region_code, coalesce(o.game_title_id, n.game_title_id) AS game_title_id,
         CASE WHEN o.game_title_id IS NULL THEN 'ADDED' WHEN n.game_title_id IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change,
         o.reason AS reason_before, n.reason AS reason_after
       FROM old o FULL JOIN new n ON o.region_code = n.region_code AND o.game_title_id = n.game_title_id
       WHERE o.reason IS DISTINCT FROM n.reason""",
)
def so3(star: Star) -> DataFrame:
    return policy.diff(star.market_game_block, edited_blocks(star), ["region_code", "game_title_id"], ["reason"])


def edited_blocks(star: Star) -> DataFrame:
    """A later version of the market blocks: some gone, some new, some with another reason."""
    key = F.col("p_partkey")
    kept = ((key % 97 == 0) & (key % 2 == 0)) | (key % 101 == 0)
    return (
        star.source("part")
        .filter(kept)
        .select(
            F.lit("EUROPE").alias("region_code"),
            key.alias("game_title_id"),
            F.when(key % 5 == 0, "reviewed").otherwise("regulatory restriction").alias("reason"),
        )
    )


def weights(star: Star) -> DataFrame:
    """Weight of each category in each player segment: (length of the segment name + id) mod 7."""
    segments = star.players.select("player_segment").distinct()
    ids = [row[0] for row in CATEGORY_ROWS]
    return segments.select(
        "player_segment", F.explode(F.array(*[F.lit(i).cast("bigint") for i in ids])).alias("category_id")
    ).withColumn("weight", ((F.length("player_segment") + F.col("category_id")) % 7).cast("int"))


POOL = f"""
WITH weights AS (
  SELECT player_segment, category_id, (length(player_segment) + category_id) % 7 AS weight
  FROM (SELECT DISTINCT player_segment FROM players) CROSS JOIN categories
), pool AS (
  SELECT player_segment, game_title_id,
         row_number() OVER (PARTITION BY player_segment ORDER BY
           {hashing.portable_sql(["game_title_id", "n"], 42)}, game_title_id, n) - 1 AS position
  FROM weights JOIN items USING (category_id), range(7) t(n) WHERE n < weight
)
"""


def pool(star: Star) -> DataFrame:
    return sampling.weighted_pool(star.items, weights(star), "player_segment", hasher=hashing.portable)


@query("ws1_weighted_pool", POOL + "SELECT player_segment, game_title_id, position FROM pool")
def ws1(star: Star) -> DataFrame:
    return pool(star)


@query("ag19_pool_size", POOL + "SELECT player_segment, count(*) AS pool_size FROM pool GROUP BY player_segment")
def ag19(star: Star) -> DataFrame:
    return sampling.pool_sizes(pool(star), "player_segment")


PICKED = POOL + f""", sizes AS (SELECT player_segment, count(*) AS pool_size FROM pool GROUP BY player_segment),
picked AS (SELECT p.player_id, p.player_segment, {hashing.portable_sql(["player_id"], 9)} % s.pool_size AS position
           FROM players p JOIN sizes s USING (player_segment))
"""


@query(
    "ws2_weighted_pick",
    PICKED + "SELECT player_id, player_segment, game_title_id FROM picked JOIN pool USING (player_segment, position)",
)
def ws2(star: Star) -> DataFrame:
    players = star.players.select("player_id", "player_segment")
    return sampling.weighted_pick(
        players, pool(star), "player_segment", ["player_id"], seed=9, hasher=hashing.portable
    ).select("player_id", "player_segment", "game_title_id")


@query(
    "jn11_segment_position_join",
    PICKED
    + """SELECT player_segment, category_id, count(*) AS picks FROM picked JOIN pool USING (player_segment, position)
         JOIN items USING (game_title_id) GROUP BY ALL""",
)
def jn11(star: Star) -> DataFrame:
    return (
        ws2(star)
        .join(star.items.select("game_title_id", "category_id"), "game_title_id")
        .groupBy("player_segment", "category_id")
        .agg(F.count(F.lit(1)).alias("picks"))
    )


@query("io3_literal_rows", "SELECT category_id, category_code, vertical, subvertical, category_name FROM categories JOIN (SELECT DISTINCT category_id FROM items) USING (category_id)")
def io3(star: Star) -> DataFrame:
    rows = values(
        star.spark,
        CATEGORY_ROWS,
        "category_id BIGINT, category_code STRING, vertical STRING, subvertical STRING, category_name STRING",
    )
    return rows.join(star.items.select("category_id").distinct(), "category_id")
