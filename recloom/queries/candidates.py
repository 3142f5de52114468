"""Candidate assembly, scoring and rails over one request per player."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions.scalars import before
from recloom.plans import candidates, exclusions, features, rails, recent, recommend, traces
from recloom.plans.scoring import expression_scorer
from recloom.queries.features import profile, rollup
from recloom.queries.prelude import candidate_rows, normed_rows
from recloom.queries.registry import query, shareable
from recloom.sources.staging import stage
from recloom.sources.star import AFFINITY, DEFAULT_REGION, EVENTS_AS_OF, REGION_PATTERN, ROUNDS_AS_OF, Star

# A fixed linear score, for comparison with SQL only; the product path scores with a fitted model.
LINEAR = (
    "aff_for_category * 0.5D + game_rounds_30d_norm * 0.3D + rtp_frac * 0.1D + recent_cat_activity_norm * 0.1D"
)
ITEM_PART = "game_rounds_30d_norm * 0.3D + rtp_frac * 0.1D"
LINEAR_SQL = "aff_for_category * 0.5::DOUBLE + coalesce(game_rounds_30d_norm, 0) * 0.3::DOUBLE + rtp_frac * 0.1::DOUBLE + recent_cat_activity_norm * 0.1::DOUBLE"

HOURS = 48


def staged_market(star: Star, rolled: DataFrame | None = None) -> DataFrame:
    played = features.item_profile(rollup(star) if rolled is None else rolled, star.items, star.categories)
    return stage(candidates.market_items(star.regions, star.items, star.categories, played, star.policies), "market")


def recent_rows(star: Star) -> DataFrame:
    """Even players are known to the tiles, the others only to the raw events."""
    plays = recent.only_plays(star.events)
    tiles = recent.minute_tiles(plays.filter(F.col("player_id") % 2 == 0), ["player_id", "category_id"])
    return recent.recent_categories(tiles, star.events, EVENTS_AS_OF, HOURS)


def last_played(star: Star) -> DataFrame:
    """Requests that name the item their player played last (odd players only)."""
    last = (
        star.rounds.groupBy("player_id")
        .agg(F.max(F.struct("round_start_timestamp", "game_title_id")).alias("last"))
        .select("player_id", F.col("last.game_title_id").alias("because_you_played"))
    )
    asked = F.when(F.col("player_id") % 2 == 1, F.col("because_you_played"))
    return star.requests.join(last, "player_id", "left").withColumn("because_you_played", asked)


@shareable
def context(star: Star) -> recommend.Context:
    """The feature tables of one refresh: the rounds are rolled up once and read three times."""
    rolled = stage(rollup(star), "rollup")
    return recommend.Context(
        star.regions, star.categories, star.items, star.players, star.policies,
        features.player_affinity(rolled, star.items, star.categories, AFFINITY),
        features.player_behavior(rolled, star.players, star.regions, star.items, star.categories, ROUNDS_AS_OF),
        staged_market(star, rolled), AFFINITY, REGION_PATTERN, DEFAULT_REGION,
    )


@shareable
def _run(star: Star, norm_scope: str, item_part: str | None) -> recommend.Recommendations:
    return recommend.recommend(
        last_played(star), context(star), expression_scorer(LINEAR), ROUNDS_AS_OF, "linear-check", recent_rows(star),
        norm_scope, profile(star) if norm_scope == "catalog" else None, item_part=item_part,
    )


def run(star: Star, norm_scope: str = "market", item_part: str | None = ITEM_PART) -> recommend.Recommendations:
    """One run over all requests; the rails expand only the items that can reach them, unless told otherwise."""
    return _run(star, norm_scope, item_part)


CANDIDATES = f"""
WITH recent AS (
  SELECT player_id, category_id, count(*) AS plays FROM plays
  WHERE event_type = 'PLAY' AND category_id IS NOT NULL AND event_ts < TIMESTAMP '{EVENTS_AS_OF}'
    AND event_ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL {HOURS} HOUR GROUP BY ALL
), last_played AS (
  SELECT player_id, game_title_id FROM (
    SELECT player_id, game_title_id, row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, game_title_id DESC) AS rn
    FROM rounds) WHERE rn = 1
), asked AS (
  SELECT q.*, CASE WHEN q.player_id % 2 = 1 THEN l.game_title_id END AS because_you_played,
         CASE WHEN q.player_id % 2 = 1 THEN i.category_id END AS played_category
  FROM resolved q LEFT JOIN last_played l USING (player_id) LEFT JOIN items i USING (game_title_id)
), {candidate_rows('asked', 'player_id')}, normed AS ({normed_rows('candidates')}
), scored AS (
  SELECT *, {LINEAR_SQL} AS score FROM normed WHERE excl_reason IS NULL
), recommended AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, game_title_id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, category_id ORDER BY score DESC, game_title_id) AS rc FROM scored)
  WHERE rc <= 4 QUALIFY rank <= top_n
), trending AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rounds_30d DESC, game_title_id) AS rank
  FROM scored) WHERE rank <= top_n
), similar_items AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, game_title_id) AS rank
  FROM scored WHERE category_id = played_category) WHERE rank <= top_n
), railed AS (
  SELECT request_id, player_id, region_code, 'recommended_for_you' AS rail, rank, game_title_id, category_id, score,
         boosted, CAST(NULL AS INTEGER) AS trend_score FROM recommended
  UNION ALL
  SELECT request_id, player_id, region_code, 'trending_in_market', rank, game_title_id, category_id, score, boosted,
         CAST(round_even(100 * (CAST(rounds_30d AS DOUBLE) / greatest(1, max(rounds_30d) OVER (PARTITION BY request_id))), 0) AS INTEGER)
  FROM trending
  UNION ALL
  SELECT request_id, player_id, region_code, 'because_you_played', rank, game_title_id, category_id, score, boosted, NULL
  FROM similar_items
)
"""

SUMMARY_SQL = """
SELECT region_code, category_id, coalesce(excl_reason, 'KEPT') AS outcome, count(*) AS candidates,
       count(DISTINCT game_title_id) AS items, max(aff_for_category) AS top_affinity, max({norm}) AS top_norm,
       min(rtp_frac) AS low_rtp, max(popularity_trend) AS top_trend, max(player_rounds_30d) AS top_player_rounds,
       max(recent_cat_activity_norm) AS top_recency
FROM {source} GROUP BY ALL"""


def summary(assembled: DataFrame) -> DataFrame:
    """Every candidate of every request, told per market, category and outcome."""
    return assembled.groupBy("region_code", "category_id", F.coalesce("excl_reason", F.lit("KEPT")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_distinct("game_title_id").alias("items"),
        F.max("aff_for_category").alias("top_affinity"),
        F.max("game_rounds_30d_norm").alias("top_norm"),
        F.min("rtp_frac").alias("low_rtp"),
        F.max("popularity_trend").alias("top_trend"),
        F.max("player_rounds_30d").alias("top_player_rounds"),
        F.max("recent_cat_activity_norm").alias("top_recency"),
    )


@query("rc2_candidate_assembly", CANDIDATES + SUMMARY_SQL.format(norm="game_rounds_30d_norm", source="normed"))
def rc2(star: Star) -> DataFrame:
    return summary(run(star).candidates)


@query(
    "rc2_candidates_norm_eligible",
    CANDIDATES
    + """, kept AS (SELECT *, CAST(rounds_30d AS DOUBLE) / nullif(max(rounds_30d) OVER (PARTITION BY request_id), 0) AS n
         FROM candidates WHERE excl_reason IS NULL)"""
    + SUMMARY_SQL.format(norm="n", source="kept"),
)
def rc2_eligible(star: Star) -> DataFrame:
    return summary(run(star, "eligible", None).candidates.filter("excl_reason IS NULL"))


@query(
    "rc2_candidates_norm_catalog",
    CANDIDATES
    + """, scoped AS (SELECT *, CAST(rounds_30d AS DOUBLE) / (SELECT greatest(max(rounds_30d), 1) FROM item_profile) AS n
         FROM candidates)"""
    + SUMMARY_SQL.format(norm="n", source="scoped"),
)
def rc2_catalog(star: Star) -> DataFrame:
    return summary(run(star, "catalog").candidates)


@query(
    "rc3_scored_candidates",
    CANDIDATES
    + """SELECT request_id, category_id, count(*) AS candidates, max(score) AS best, min(score) AS worst,
         bool_or(boosted) AS boosted FROM scored GROUP BY ALL""",
)
def rc3(star: Star) -> DataFrame:
    return run(star).scored.groupBy("request_id", "category_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.max("score").alias("best"),
        F.min("score").alias("worst"),
        F.bool_or("boosted").alias("boosted"),
    )


RAILS_SQL = CANDIDATES + "SELECT request_id, rail, rank, game_title_id, score, trend_score FROM railed"


@query("rc4_diversified_rails", RAILS_SQL)
def rc4(star: Star) -> DataFrame:
    return run(star).rails.select("request_id", "rail", "rank", "game_title_id", "score", "trend_score")


@query("rc4_rails_all_candidates", RAILS_SQL)
def rc4_all(star: Star) -> DataFrame:
    """The same rails cut from every scored candidate, as a scorer that is not additive needs it."""
    done = run(star, item_part=None)
    return done.rails.select("request_id", "rail", "rank", "game_title_id", "score", "trend_score")


SATURATED_SQL = RAILS_SQL.replace(LINEAR_SQL, f"40::DOUBLE + ({LINEAR_SQL})").replace(" score, trend_score FROM", " 1.0::DOUBLE AS score, trend_score FROM")


@query("rc4_rails_saturated", SATURATED_SQL)
def rc4_saturated(star: Star) -> DataFrame:
    """A probability that rounds to 1 for every item: the margin behind it keeps the order."""
    margin = f"40.0D + ({LINEAR})"
    done = recommend.recommend(
        last_played(star), context(star), expression_scorer(f"1.0D / (1.0D + exp(-({margin})))", margin), ROUNDS_AS_OF,
        "saturated-check", recent_rows(star), item_part=ITEM_PART,
    )
    return done.rails.select("request_id", "rail", "rank", "game_title_id", "score", "trend_score")


DECISIONS_SQL = CANDIDATES + """, decided AS (
  SELECT request_id, count(*) FILTER (excl_reason IS NULL) AS candidate_set_size,
         count(*) FILTER (excl_reason IS NOT NULL) AS excluded_count,
         count(DISTINCT CASE WHEN excl_reason = 'MARKET_GAME_BLOCK' THEN game_title_id END) AS blocks,
         string_agg(DISTINCT CASE WHEN excl_reason = 'MARKET_CATEGORY_EXCLUSION' THEN category_id::VARCHAR END, ',') AS market_categories,
         string_agg(DISTINCT CASE WHEN excl_reason = 'PLAYER_CATEGORY_EXCLUSION' THEN category_id::VARCHAR END, ',') AS player_categories,
         string_agg(DISTINCT CASE WHEN excl_reason = 'PLAYER_SUBVERTICAL_EXCLUSION' THEN subvertical END, ',') AS player_subverticals
  FROM candidates GROUP BY request_id
), listed AS (
  SELECT request_id, count(*) AS listed, min(game_title_id) AS first_listed, max(game_title_id) AS last_listed,
         CAST(sum(game_title_id) AS BIGINT) AS listed_sum FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY game_title_id) AS rn FROM candidates
    WHERE excl_reason IS NOT NULL) WHERE rn <= 200 GROUP BY request_id
), shown AS (
  SELECT request_id, count(*) AS shown FROM railed GROUP BY request_id
)
"""


@query(
    "rc5_traces",
    DECISIONS_SQL
    + """SELECT d.request_id, d.candidate_set_size, d.excluded_count, d.blocks,
           coalesce(d.market_categories, '') AS market_categories, coalesce(d.player_categories, '') AS player_categories,
           coalesce(d.player_subverticals, '') AS player_subverticals, coalesce(l.listed, 0) AS listed,
           l.first_listed, l.last_listed, coalesce(l.listed_sum, 0) AS listed_sum, s.shown
         FROM decided d LEFT JOIN listed l USING (request_id) LEFT JOIN shown s USING (request_id)""",
)
def rc5(star: Star) -> DataFrame:
    ids = F.transform("excluded_candidates", lambda e: e["game_title_id"])
    rules = "rules_applied"
    done = run(star)
    key = done.requests.select(
        "request_id", F.sha2(F.concat_ws("|", "request_id", F.lit(done.generated_at)), 256).alias("trace_id")
    )
    # Counted before the join: a trace holds the whole block list of its market.
    told = done.traces.select(
        "trace_id",
        "candidate_set_size",
        "excluded_count",
        F.size(f"{rules}.market_game_blocks").cast("bigint").alias("blocks"),
        F.array_join(F.col(f"{rules}.market_category_exclusions").cast("array<string>"), ",").alias("market_categories"),
        F.array_join(F.col(f"{rules}.player_category_exclusions").cast("array<string>"), ",").alias("player_categories"),
        F.array_join(f"{rules}.player_subvertical_exclusions", ",").alias("player_subverticals"),
        F.size("excluded_candidates").cast("bigint").alias("listed"),
        F.array_min(ids).alias("first_listed"),
        F.array_max(ids).alias("last_listed"),
        F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("listed_sum"),
        F.size("top_n").cast("bigint").alias("shown"),
    )
    return told.join(key, "trace_id").select("request_id", *told.columns[1:])


@query(
    "ag12_rules_applied",
    CANDIDATES
    + """SELECT DISTINCT request_id,
           CASE excl_reason WHEN 'MARKET_GAME_BLOCK' THEN 'market_game_blocks'
             WHEN 'MARKET_CATEGORY_EXCLUSION' THEN 'market_category_exclusions'
             WHEN 'PLAYER_CATEGORY_EXCLUSION' THEN 'player_category_exclusions' ELSE 'player_subvertical_exclusions' END AS rule,
           CASE excl_reason WHEN 'MARKET_GAME_BLOCK' THEN game_title_id::VARCHAR
             WHEN 'PLAYER_SUBVERTICAL_EXCLUSION' THEN subvertical ELSE category_id::VARCHAR END AS value
         FROM candidates WHERE excl_reason IS NOT NULL""",
)
def ag12(star: Star) -> DataFrame:
    return recommend.rules_long(run(star).decisions)


@query(
    "ag13_exclusions_by_reason",
    CANDIDATES
    + """SELECT request_id, excl_reason AS reason, count(*) AS items FROM (
           SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY game_title_id) AS rn FROM candidates
           WHERE excl_reason IS NOT NULL) WHERE rn <= 200 GROUP BY ALL""",
)
def ag13(star: Star) -> DataFrame:
    return traces.exclusions_by_reason(run(star).decisions.withColumnRenamed("request_id", "trace_id")).withColumnRenamed(
        "trace_id", "request_id"
    )


@query(
    "ag13_exclusions_whole",
    CANDIDATES + "SELECT request_id, excl_reason AS reason, count(*) AS items FROM candidates WHERE excl_reason IS NOT NULL GROUP BY ALL",
)
def ag13_whole(star: Star) -> DataFrame:
    """All exclusions of every request by reason, counted from the bitmaps of its set of rules."""
    done = run(star)
    named = exclusions.with_rule_set(done.requests)
    items = exclusions.rule_items(done.market)
    sets = stage(exclusions.rule_sets(named), "rule-sets")
    counted = exclusions.counts(sets, stage(exclusions.rule_bitmaps(items), "rule-bitmaps"))
    return named.select("request_id", "rule_set").join(counted, "rule_set").select("request_id", "reason", "items")


@query(
    "rc5_exclusions_whole",
    CANDIDATES
    + """SELECT request_id, excl_reason AS reason, count(*) AS items, min(game_title_id) AS first_id, max(game_title_id) AS last_id,
           CAST(sum(game_title_id) AS BIGINT) AS id_sum FROM candidates WHERE excl_reason IS NOT NULL GROUP BY ALL""",
)
def rc5_whole(star: Star) -> DataFrame:
    """The whole list of exclusions behind every trace: kept once per set of rules, told per request."""
    done = run(star)
    named = exclusions.with_rule_set(done.requests)
    sets = stage(exclusions.rule_sets(named), "rule-sets")
    listed = exclusions.whole_list(sets, exclusions.rule_items(done.market))
    ids = F.col("game_title_id")
    told = listed.groupBy("rule_set", "reason").agg(
        F.count(ids).alias("items"), F.min(ids).alias("first_id"), F.max(ids).alias("last_id"), F.sum(ids).alias("id_sum")
    )
    return named.select("request_id", "rule_set").join(told, "rule_set").drop("rule_set")


@query(
    "rc6_latest_of_several",
    DECISIONS_SQL
    + """SELECT q.player_id, v.recency, v.request_ts, d.candidate_set_size FROM resolved q LEFT JOIN decided d USING (request_id),
           (VALUES (1, TIMESTAMP '2001-11-07 00:00:00'), (2, TIMESTAMP '2001-11-06 00:00:00')) v(recency, request_ts)""",
)
def rc6_several(star: Star) -> DataFrame:
    """Three traces of every player, of which the latest two are told."""
    done = run(star)
    several = None
    for day in ("2001-11-05", "2001-11-06", "2001-11-07"):
        told = traces.traces(done.decisions, done.rails, done.model_version, f"{day} 00:00:00")
        several = told if several is None else several.unionByName(told)
    return traces.telemetry(several, star.players, 2).select("player_id", "recency", "request_ts", "candidate_set_size")
