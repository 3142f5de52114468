"""Which items a market may show, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A market list is a regulatory configuration; a longer one points to a wrong table.
MAX_MARKETS = 10_000


def in_market(region: Column) -> Column:
    """NULL for a non-global item without a home market: neither in nor out."""
    return F.col("is_global_yn") | (F.col("home_region_code") == region)


def region_list(regions: DataFrame) -> Column:
    """All market codes as one array, read by a scalar subquery; more than MAX_MARKETS fail the query."""
    codes = F.sort_array(F.collect_set("region_code"))
    return regions.agg(
        F.when(F.count_distinct("region_code") <= MAX_MARKETS, codes).otherwise(
            F.raise_error(F.lit("market list is too long to expand")).cast("array<string>")
        )
    ).scalar()


def flag_policies(df: DataFrame, policies: dict[str, DataFrame], by_player: bool = False) -> DataFrame:
    """Left-join the policy tables as existence flags. Keys are made distinct, so no row fans out.

    AQE broadcasts the policy side when its measured size is small and splits hot keys otherwise.
    """
    def mark(out: DataFrame, table: str, keys: list[str], name: str) -> DataFrame:
        rules = policies[table].select(*keys).dropDuplicates().withColumn(name, F.lit(True))
        return out.join(rules, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))

    df = mark(df, "market_game_block", ["region_code", "game_title_id"], "is_blocked")
    df = mark(df, "market_category_exclusion", ["region_code", "category_id"], "is_market_excluded")
    if by_player:
        df = mark(df, "player_category_exclusion", ["player_id", "category_id"], "is_player_excluded")
        df = mark(df, "player_subvertical_exclusion", ["player_id", "subvertical"], "is_subvertical_excluded")
    return df


def market_eligible(
    regions: DataFrame, items: DataFrame, categories: DataFrame, policies: dict[str, DataFrame]
) -> DataFrame:
    """Every (market, item) with three-valued ``is_eligible`` and the first reason against it.

    Items are expanded by the market array in place: no join, no shuffle of the catalogue.
    """
    universe = (
        items.select("game_title_id", "category_id", "available_for_play_yn", "is_global_yn", "home_region_code")
        .join(categories.select("category_id", "subvertical"), "category_id")
        .withColumn("region_code", F.explode(region_list(regions)))
    )
    flagged = flag_policies(universe, policies)
    available, market = F.col("available_for_play_yn"), in_market(F.col("region_code"))
    return flagged.select(
        "region_code",
        "game_title_id",
        "category_id",
        "subvertical",
        (available & market & ~F.col("is_blocked") & ~F.col("is_market_excluded")).alias("is_eligible"),
        F.when(~available, "GAME_UNAVAILABLE")
        .when(~market, "NOT_IN_MARKET")
        .when(F.col("is_blocked"), "MARKET_GAME_BLOCK")
        .when(F.col("is_market_excluded"), "MARKET_CATEGORY_EXCLUSION")
        .alias("ineligible_reason"),
    )
