"""Every exclusion of every request, without a list per request.

What a request must not show depends on its market and on the rules its player has set, and few sets of rules
occur. So the items behind a rule are kept once, as rows and as bitmaps of their ids; a request only names its set
of rules. Counts per reason come from the bitmaps of a set, whole lists from its rows; neither has a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, MARKET_CATEGORY = "MARKET_GAME_BLOCK", "MARKET_CATEGORY_EXCLUSION"
PLAYER_CATEGORY, PLAYER_SUBVERTICAL = "PLAYER_CATEGORY_EXCLUSION", "PLAYER_SUBVERTICAL_EXCLUSION"
PRECEDENCE = [BLOCK, MARKET_CATEGORY, PLAYER_CATEGORY, PLAYER_SUBVERTICAL]


def rule_items(market: DataFrame) -> DataFrame:
    """(region_code, rule, reason, game_title_id): the items of each market behind each rule.

    A market's own rules are named by their reason. Items that these leave are listed under the category and the
    subvertical that a player may exclude.
    """
    closed = market.filter("market_reason IS NOT NULL").select(
        "region_code", F.col("market_reason").alias("rule"), F.col("market_reason").alias("reason"), "game_title_id"
    )
    by_player = F.explode(
        F.array(
            F.struct(_category(F.col("category_id")).alias("rule"), F.lit(PLAYER_CATEGORY).alias("reason")),
            F.struct(_subvertical(F.col("subvertical")).alias("rule"), F.lit(PLAYER_SUBVERTICAL).alias("reason")),
        )
    ).alias("r")
    opened = market.filter("market_reason IS NULL").select("region_code", by_player, "game_title_id")
    opened = opened.select("region_code", "r.rule", "r.reason", "game_title_id").filter("rule IS NOT NULL")
    return closed.unionByName(opened)


def _category(category: Column) -> Column:
    return F.concat(F.lit("category:"), category.cast("string"))


def _subvertical(name: Column) -> Column:
    return F.concat(F.lit("subvertical:"), name)


def rule_bitmaps(items: DataFrame) -> DataFrame:
    """(region_code, rule, reason, bucket, bitmap): the ids of ``rule_items`` as bitmaps of 32,768 ids each."""
    marked = items.select(
        "region_code", "rule", "reason",
        F.bitmap_bucket_number("game_title_id").alias("bucket"), F.bitmap_bit_position("game_title_id").alias("bit"),
    )
    return marked.groupBy("region_code", "rule", "reason", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def with_rule_set(requests: DataFrame) -> DataFrame:
    """Enriched requests with ``rules`` (the player's, sorted) and ``rule_set``, a name of them and the market."""
    empty = F.array().cast("array<string>")
    categories = F.transform(F.coalesce("excluded_categories", F.array().cast("array<bigint>")), _category)
    subverticals = F.transform(F.coalesce("excluded_subverticals", empty), _subvertical)
    rules = F.array_sort(F.array_distinct(F.filter(F.concat(categories, subverticals), lambda x: x.isNotNull())))
    named = requests.withColumn("rules", rules)
    return named.withColumn("rule_set", F.sha2(F.concat_ws("|", "region_code", "rules"), 256))


def rule_sets(requests: DataFrame) -> DataFrame:
    """The sets of rules that occur: (rule_set, region_code, rules)."""
    return requests.groupBy("rule_set").agg(F.any_value("region_code").alias("region_code"), F.any_value("rules").alias("rules"))


def _asked(sets: DataFrame) -> DataFrame:
    """(rule_set, region_code, rule): the rules of a set, with those of its market."""
    own = F.array(F.lit(BLOCK), F.lit(MARKET_CATEGORY))
    return sets.select("rule_set", "region_code", F.explode(F.concat(own, "rules")).alias("rule"))


def counts(sets: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(rule_set, reason, items): the whole number of exclusions per reason; reasons without any have no row.

    An item counts under its first reason. A market's rules and what they leave have no item in common, nor have
    two categories; a subvertical counts with what it adds to the categories.
    """
    found = _asked(sets).join(bitmaps, ["region_code", "rule"])
    category, subvertical = (F.col("reason") == r for r in (PLAYER_CATEGORY, PLAYER_SUBVERTICAL))

    def size(cond: Column) -> Column:
        return F.coalesce(F.bitmap_count(F.bitmap_or_agg(F.when(cond, F.col("bitmap")))), F.lit(0))

    per_bucket = found.groupBy("rule_set", "bucket").agg(
        size(F.col("reason") == BLOCK).alias(BLOCK),
        size(F.col("reason") == MARKET_CATEGORY).alias(MARKET_CATEGORY),
        size(category).alias(PLAYER_CATEGORY),
        (size(category | subvertical) - size(category)).alias(PLAYER_SUBVERTICAL),
    )
    totals = per_bucket.groupBy("rule_set").agg(*[F.sum(r).alias(r) for r in PRECEDENCE])
    return totals.unpivot("rule_set", PRECEDENCE, "reason", "items").filter("items > 0")


def whole_list(sets: DataFrame, items: DataFrame) -> DataFrame:
    """(rule_set, game_title_id, reason): every excluded item of a set under its first reason."""
    order = F.array_position(F.array(*[F.lit(r) for r in PRECEDENCE]), F.col("reason"))
    found = _asked(sets).join(items, ["region_code", "rule"])
    first = found.groupBy("rule_set", "game_title_id").agg(F.min_by("reason", order).alias("reason"))
    return first.select("rule_set", "game_title_id", "reason")
