"""The five batch feature tables.

Four of them come from one roll-up of the play rounds by (player, item): the fact table is
scanned and shuffled once, distinct counts turn into plain counts, and a hot player or item
is spread over its partners before any per-player or per-item grouping.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recloom.functions.scalars import before, decay_units, div0, flag, instant, popularity_trend
from recloom.schemas import AFFINITY_COLUMNS

MONEY = "decimal(38,6)"


def player_item_rollup(rounds: DataFrame, as_of: str, horizon_days: int = 180, floor: float = 0.05) -> DataFrame:
    """Rounds before ``as_of`` per player and item, with every sum the feature tables need.

    ``weight_units`` is the recency weight in hundredth-days, see ``decay_units``.
    """
    ts = F.col("round_start_timestamp")
    since = {days: ts >= before(as_of, days=days) for days in (7, 30, 60, 90)}
    stake = F.col("stake_total_amt_eur")
    ggr = stake - F.col("payout_total_amt_eur")
    age = F.datediff(instant(as_of).cast("date"), F.to_date(ts))
    return (
        rounds.filter(ts < instant(as_of))
        .groupBy("player_id", "game_title_id")
        .agg(
            F.count(F.lit(1)).alias("rounds"),
            F.count_if(since[7]).alias("rounds_7d"),
            F.count_if(since[30]).alias("rounds_30d"),
            F.count_if(since[90]).alias("rounds_90d"),
            F.count_if(since[60] & ~since[30]).alias("rounds_prev_30d"),
            F.sum(stake).alias("stake"),
            F.count(stake).alias("staked"),
            F.sum(ggr).alias("ggr"),
            F.sum(F.when(since[30], ggr)).alias("ggr_30d"),
            F.max(ts).alias("last_ts"),
            F.sum(decay_units(age, horizon_days, floor)).alias("weight_units"),
        )
    )


def player_behavior(
    rollup: DataFrame, players: DataFrame, regions: DataFrame, items: DataFrame, categories: DataFrame, as_of: str
) -> DataFrame:
    """Counts, stakes and preferred vertical of each player; players without rounds are kept.

    The preferred vertical and subvertical are modes: most rounds first, lowest name on ties.
    """
    kinds = items.select("game_title_id", "category_id").join(
        categories.select("category_id", "vertical", "subvertical"), "category_id", "left"
    )
    sums = ["rounds", "items", "rounds_7d", "rounds_30d", "rounds_90d", "stake", "staked", "ggr"]

    def add_up() -> list[Column]:
        return [*[F.sum(s).alias(s) for s in sums], F.max("last_ts").alias("last_ts")]

    def preferred(name: str) -> Column:
        return F.min(F.when(F.col(name).isNotNull(), F.struct(-F.col("rounds"), F.col(name))))

    by_subvertical = (
        rollup.withColumn("items", F.lit(1).cast("bigint"))
        .join(kinds.drop("category_id"), "game_title_id", "left")
        .groupBy("player_id", "vertical", "subvertical")
        .agg(*add_up())
    )
    by_vertical = by_subvertical.groupBy("player_id", "vertical").agg(*add_up())
    # a subvertical may stand under several verticals: its rounds are added up over them
    whole = by_subvertical.groupBy("player_id", "subvertical").agg(F.sum("rounds").alias("rounds"))
    favourite = whole.groupBy("player_id").agg(preferred("subvertical").alias("best_subvertical"))
    by_player = (
        by_vertical.groupBy("player_id")
        .agg(*add_up(), preferred("vertical").alias("best_vertical"))
        .join(favourite, "player_id", "left")
    )
    last = F.col("last_ts")
    stake, ggr = F.coalesce("stake", F.lit(0)), F.coalesce("ggr", F.lit(0))
    return (
        players.select("player_id", "player_segment", "region_id")
        .join(regions.select("region_id", "region_code"), "region_id")
        .join(by_player, "player_id", "left")
        .select(
            "player_id",
            "player_segment",
            "region_id",
            "region_code",
            F.coalesce("rounds", F.lit(0)).alias("total_rounds"),
            F.coalesce("items", F.lit(0)).alias("distinct_games"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rounds_7d", "rounds_30d", "rounds_90d")],
            stake.cast("double").alias("total_stake_eur"),
            F.coalesce(stake.cast("double") / F.nullif(F.col("staked"), F.lit(0)), F.lit(0.0)).alias("avg_stake_eur"),
            ggr.cast("double").alias("total_ggr_eur"),
            last.alias("last_activity_ts"),
            F.datediff(instant(as_of).cast("date"), F.to_date(last)).alias("days_since_last_play"),
            F.col("best_vertical.vertical").alias("pref_vertical"),
            F.col("best_subvertical.subvertical").alias("pref_subvertical"),
        )
    )


def player_affinity(
    rollup: DataFrame,
    items: DataFrame,
    categories: DataFrame,
    columns: Mapping[int, str] = AFFINITY_COLUMNS,
    horizon_days: int = 180,
) -> DataFrame:
    """Recency-weighted category shares of each player, one wide row."""
    weighted = rollup.select("player_id", "game_title_id", "weight_units").join(
        items.select("game_title_id", "category_id").join(categories.select("category_id"), "category_id"),
        "game_title_id",
    )
    units = F.col("weight_units")
    sums = weighted.groupBy("player_id").agg(
        F.sum(units).alias("_all"),
        *[F.sum(F.when(F.col("category_id") == cid, units).otherwise(0)).alias(f"_{cid}") for cid in columns],
    )
    return sums.select(
        "player_id",
        (F.col("_all").cast("double") / F.lit(100.0 * horizon_days)).alias("affinity_weight_total"),
        *[div0(F.col(f"_{cid}"), F.col("_all")).alias(name) for cid, name in columns.items()],
    )


def affinity_long(affinity: DataFrame, columns: Mapping[int, str] = AFFINITY_COLUMNS) -> DataFrame:
    """Wide affinity back to one row per player and category."""
    ids = F.create_map(*[part for cid, name in columns.items() for part in (F.lit(name), F.lit(cid).cast("bigint"))])
    return affinity.unpivot("player_id", list(columns.values()), "name", "affinity").select(
        "player_id", ids[F.col("name")].alias("category_id"), "affinity"
    )


def affinity_map(columns: Mapping[int, str] = AFFINITY_COLUMNS) -> Column:
    """The wide row as a map from category to share."""
    return F.create_map(
        *[part for cid, name in columns.items() for part in (F.lit(cid).cast("bigint"), F.col(name))]
    )


def affinity_of(shares: Column, category: Column, columns: Mapping[int, str] = AFFINITY_COLUMNS) -> Column:
    """The share of ``category`` in a map; categories without a column of their own use the first one."""
    fallback = shares[F.lit(next(iter(columns))).cast("bigint")]
    return F.when(category.isin(*columns), shares[category]).otherwise(fallback)


def item_profile(rollup: DataFrame, items: DataFrame, categories: DataFrame) -> DataFrame:
    """Popularity, trend and revenue of each item with its catalogue attributes; unplayed items are kept."""
    played = rollup.groupBy("game_title_id").agg(
        F.sum("rounds_30d").alias("r30"),
        F.count_if(F.col("rounds_30d") > 0).alias("p30"),
        F.sum("rounds_prev_30d").alias("prev"),
        F.sum("ggr_30d").alias("ggr30"),
        F.max("last_ts").alias("last_played_ts"),
    )
    attributes = [
        c
        for c in (
            "game_title_id", "game_title", "category_id", "vertical", "subvertical", "studio_name",
            "return_to_player_pct", "has_jackpot_yn", "is_global_yn", "home_region_code", "tile_image_url",
            "tile_color_hex",
        )
    ]
    rounds_30d, previous = F.coalesce("r30", F.lit(0)), F.coalesce("prev", F.lit(0))
    return (
        items.join(categories.select("category_id", "vertical", "subvertical"), "category_id")
        .select(*attributes)
        .join(played, "game_title_id", "left")
        .select(
            *attributes,
            rounds_30d.alias("rounds_30d"),
            F.coalesce("p30", F.lit(0)).alias("players_30d"),
            previous.alias("rounds_prev_30d"),
            F.coalesce("ggr30", F.lit(0)).cast("double").alias("ggr_30d_eur"),
            popularity_trend(rounds_30d, previous).alias("popularity_trend"),
            "last_played_ts",
        )
    )


def interactions(rollup: DataFrame, items: DataFrame) -> DataFrame:
    """One positive label per player and item played."""
    return rollup.join(items.select("game_title_id", "category_id"), "game_title_id").select(
        "player_id",
        "game_title_id",
        "category_id",
        F.col("rounds").alias("play_count"),
        F.col("stake").cast("double").alias("stake_eur"),
        F.col("last_ts").alias("last_play_ts"),
        F.lit(1).alias("label"),
    )


def behavior_view(behavior: DataFrame) -> DataFrame:
    """The behaviour table as a timestamped feature view keyed by player."""
    stamp = F.coalesce("last_activity_ts", instant("2020-01-01 00:00:00"))
    return behavior.select(
        "player_id", "total_rounds", "distinct_games", "rounds_7d", "rounds_30d", "rounds_90d", "total_stake_eur",
        "avg_stake_eur", "total_ggr_eur", "days_since_last_play", "player_segment", "pref_vertical",
        "pref_subvertical", "region_code", stamp.alias("last_activity_ts"),
    )


def item_view(profile: DataFrame) -> DataFrame:
    """The item profile as a timestamped feature view keyed by item."""
    return profile.select(
        "game_title_id", "category_id", "vertical", "subvertical",
        F.col("return_to_player_pct").cast("double").alias("return_to_player_pct"),
        flag(F.col("has_jackpot_yn")).alias("has_jackpot"),
        "rounds_30d", "players_30d", "ggr_30d_eur", "popularity_trend",
        F.coalesce("last_played_ts", instant("2020-01-01 00:00:00")).alias("last_played_ts"),
    )


def affinity_by_segment(affinity: DataFrame, behavior: DataFrame, segment: str, columns: Mapping[str, str]) -> DataFrame:
    """Average of affinity columns within one segment against all others (skew check).

    ``columns`` maps an output name to an affinity column.
    """
    both = affinity.join(behavior.select("player_id", "player_segment"), "player_id")
    inside = F.col("player_segment") == segment
    exact = {out: F.col(col).cast("decimal(28,18)") for out, col in columns.items()}
    return both.agg(
        *[
            (F.sum(F.when(cond, col)).cast("double") / F.nullif(F.count_if(cond), F.lit(0))).alias(f"{out}_{where}")
            for out, col in exact.items()
            for where, cond in (("inside", inside), ("outside", ~inside))
        ]
    )
