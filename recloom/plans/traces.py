"""Trace rows, their telemetry, and the latency waterfall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recloom.functions.scalars import card_score, instant, stable_uuid
from recloom.operators.ranking import top_per_group
from recloom.plans.candidates import TRACE_EXCLUSIONS, market_summary, open_groups

STAGES = ["resolve", "recent_activity", "assemble", "rank"]


def decisions(requests: DataFrame, market: DataFrame) -> DataFrame:
    """Candidate count, exclusions and rules of each request, without expanding its candidates.

    Every item of a category shares the player rules, so counts and lowest ids per
    (market, category) are enough. ``excluded_candidates`` lists the lowest
    ``TRACE_EXCLUSIONS`` ids; ``excluded_count`` is the full number. The market's whole block list comes with every
    row, so what else a request needs is joined before (see ``with_shown``) and kept here.
    """
    groups = F.coalesce(
        "groups",
        F.array().cast(
            "array<struct<category_id:bigint,subvertical:string,items:bigint,most:bigint,lowest:array<bigint>>>"
        ),
    )
    by_category = F.filter(groups, lambda g: F.array_contains("excluded_categories", g["category_id"]))
    by_subvertical = F.filter(
        groups,
        lambda g: F.array_contains("excluded_subverticals", g["subvertical"])
        & ~F.array_contains("excluded_categories", g["category_id"]),
    )

    def with_reason(found, reason: str):
        return F.flatten(
            F.transform(
                found,
                lambda g: F.transform(
                    g["lowest"], lambda i: F.struct(i.alias("game_title_id"), F.lit(reason).alias("reason"))
                ),
            )
        )

    listed = F.sort_array(
        F.concat(
            F.coalesce("removed", F.array().cast("array<struct<game_title_id:bigint,reason:string>>")),
            with_reason(by_category, "PLAYER_CATEGORY_EXCLUSION"),
            with_reason(by_subvertical, "PLAYER_SUBVERTICAL_EXCLUSION"),
        )
    )
    size = F.aggregate(open_groups(), F.lit(0).cast("bigint"), lambda total, g: total + g["items"])
    ids = F.array().cast("array<bigint>")
    rules = F.struct(
        F.lit(True).alias("market_eligibility"),
        F.coalesce("market_game_blocks", ids).alias("market_game_blocks"),
        F.coalesce("market_category_exclusions", ids).alias("market_category_exclusions"),
        F.array_sort(F.transform(by_category, lambda g: g["category_id"])).alias("player_category_exclusions"),
        F.array_sort(F.array_distinct(F.transform(by_subvertical, lambda g: g["subvertical"]))).alias(
            "player_subvertical_exclusions"
        ),
        F.col("feature_source"),
        F.lit("model").alias("scoring"),
        F.transform_values("recent", lambda _, n: n.cast("double")).alias("recent_categories"),
    )
    return (
        requests.join(market_summary(market), "region_code", "left")
        .withColumn("candidate_set_size", size)
        .withColumn("excluded_count", F.coalesce("shown_items", F.lit(0)) - F.col("candidate_set_size"))
        .withColumn("rules_applied", rules)
        .withColumn("excluded_candidates", F.slice(listed, 1, TRACE_EXCLUSIONS))
        .select(
            "request_id",
            "player_id",
            "region_code",
            "page_context",
            "candidate_set_size",
            "excluded_count",
            "rules_applied",
            "excluded_candidates",
            *[c for c in ("_top",) if c in requests.columns],
        )
    )


def with_shown(requests: DataFrame, railed: DataFrame) -> DataFrame:
    """``requests`` with the rows their rails show as ``_top``, in order of rail and rank."""
    shown = F.struct("rail", "rank", "game_title_id", card_score(F.col("score")).alias("score"))
    # A request shows at most rails x top_n rows.
    top = railed.groupBy("request_id").agg(F.sort_array(F.collect_list(shown)).alias("_top"))
    return requests.join(top, "request_id", "left")


def traces(
    decided: DataFrame, railed: DataFrame, model_version: str, generated_at: str, latency: DataFrame | None = None
) -> DataFrame:
    """One row per request: what was considered, what was removed and why, what was shown.

    ``latency`` optionally maps ``request_id`` to the stage durations; otherwise they are NULL. Where ``decided``
    was made of requests ``with_shown``, its long rows need no join with ``railed``.
    """
    durations = "struct<resolve:double,recent_activity:double,assemble:double,rank:double,total:double>"
    out = decided if "_top" in decided.columns else with_shown(decided, railed)
    if latency is None:
        out = out.withColumn("latency_breakdown_ms", F.lit(None).cast(durations))
    else:
        out = out.join(latency.select("request_id", "latency_breakdown_ms"), "request_id", "left")
    return out.select(
        stable_uuid(F.col("request_id"), F.lit(generated_at)).alias("trace_id"),
        instant(generated_at).alias("request_ts"),
        "player_id",
        "region_code",
        "page_context",
        "candidate_set_size",
        "excluded_count",
        "rules_applied",
        "excluded_candidates",
        F.transform(
            F.coalesce(
                "_top",
                F.array().cast("array<struct<rail:string,rank:int,game_title_id:bigint,score:double>>"),
            ),
            lambda t: F.struct(t["rail"], t["game_title_id"], t["score"]),
        ).alias("top_n"),
        F.lit(model_version).alias("model_version"),
        "latency_breakdown_ms",
    )


def recommendation_rows(railed: DataFrame, model_version: str, generated_at: str) -> DataFrame:
    """The persisted output, one row per (rail, rank), scores rounded as shown."""
    return railed.select(
        stable_uuid(F.col("request_id"), F.lit(generated_at), F.col("rail"), F.col("rank")).alias("rec_id"),
        "player_id",
        "region_code",
        "rail",
        F.col("rank").cast("bigint").alias("rank"),
        "game_title_id",
        card_score(F.col("score")).alias("score"),
        F.lit(model_version).alias("model_version"),
        instant(generated_at).alias("generated_at"),
    )


def inference_rows(scored: DataFrame, event_ts) -> DataFrame:
    """The inference log: one row per scored candidate, features filled, raw score, one time per request."""
    from recloom.plans.scoring import fill_features
    from recloom.schemas import FEATURE_COLS

    return fill_features(scored).select(
        stable_uuid(F.col("request_id"), F.col("game_title_id"), event_ts).alias("row_id"),
        event_ts.alias("event_ts"),
        *FEATURE_COLS,
        "score",
        "region_code",
    )


def exclusions_by_reason(trace_rows: DataFrame) -> DataFrame:
    """How many listed exclusions each trace has per reason."""
    return (
        trace_rows.select("trace_id", F.explode("excluded_candidates").alias("e"))
        .groupBy("trace_id", F.coalesce("e.reason", F.lit("UNKNOWN")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("items"))
    )


def telemetry(trace_rows: DataFrame, players: DataFrame, limit: int = 8) -> DataFrame:
    """The latest traces of the given players, at most 1..25 each, with exclusions per reason."""
    k = max(1, min(int(limit), 25))
    recent = top_per_group(
        trace_rows.join(players.select("player_id").distinct(), "player_id", "left_semi"),
        ["player_id"],
        [F.desc("request_ts"), F.col("trace_id")],
        k,
        "recency",
    )
    # The list is at most TRACE_EXCLUSIONS long and has four reasons.
    reasons = F.array_sort(F.array_distinct(F.transform("excluded_candidates", lambda e: e["reason"])))
    by_reason = F.map_from_entries(
        F.transform(
            reasons,
            lambda r: F.struct(r, F.size(F.filter("excluded_candidates", lambda e: e["reason"] == r))),
        )
    )
    return recent.select(
        "player_id",
        "recency",
        "trace_id",
        "request_ts",
        "region_code",
        "page_context",
        "candidate_set_size",
        F.size("excluded_candidates").alias("excluded_count"),
        F.col("rules_applied.scoring").alias("scoring"),
        F.col("rules_applied.feature_source").alias("feature_source"),
        "model_version",
        *[F.col(f"latency_breakdown_ms.{s}").alias(f"latency_{s}") for s in [*STAGES, "total"]],
        by_reason.alias("exclusions_by_reason"),
    )


def waterfall(latencies: DataFrame, key: str = "trace_id", min_width_pct: float = 0.6) -> DataFrame:
    """Stage bars of each trace: offset and width in percent of the total, and the overhead in ms.

    ``latencies`` has one DOUBLE column per stage plus ``total``; missing ones count as 0.
    """
    safe = {s: F.coalesce(F.nanvl(F.col(s), F.lit(0.0)), F.lit(0.0)) for s in [*STAGES, "total"]}
    filled = latencies.select(key, *[c.alias(s) for s, c in safe.items()])
    stages = filled.select(
        key,
        "total",
        F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("ms")) for s in STAGES])).alias(
            "position", "s"
        ),
    ).select(key, "total", "position", "s.stage", "s.ms")
    ordered = Window.partitionBy(key).orderBy("position")
    whole = Window.partitionBy(key)
    cursor = F.coalesce(F.sum("ms").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    all_stages = F.sum("ms").over(whole.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    longest = F.greatest(F.col("total"), all_stages)
    span = F.when(longest == 0, F.lit(1.0)).otherwise(longest)
    return stages.select(
        key,
        "position",
        "stage",
        "ms",
        (cursor / span * 100).alias("offset_pct"),
        F.greatest(F.col("ms") / span * 100, F.lit(min_width_pct)).alias("width_pct"),
        F.greatest(F.col("total") - all_stages, F.lit(0.0)).alias("overhead_ms"),
    )
