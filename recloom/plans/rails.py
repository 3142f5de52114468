"""Cutting scored candidates into diversified top-N rails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recloom.functions.scalars import card_score, match_percent, trend_index
from recloom.operators.ranking import top_per_group

RECOMMENDED = "recommended_for_you"
TRENDING = "trending_in_market"
SIMILAR = "because_you_played"
MAX_PER_CATEGORY = 4
FLOORS = ["_floor_in_category", "_floor_rounds", "_floor_similar"]


def rank_value(df: DataFrame) -> str:
    """``rank_score``, what a scorer computes before it is squashed into 0..1, else the score. A probability that
    rounds to 1 for many items still leaves them in order."""
    return "rank_score" if "rank_score" in df.columns else "score"


def best_first(df: DataFrame) -> list[Column]:
    """By ``rank_value``; the lower id wins a tie."""
    return [F.desc(rank_value(df)), F.col("game_title_id")]


def longest_rail(requests: DataFrame) -> int:
    """The largest ``top_n`` asked for: one number, which lets Spark cut groups before it shuffles them."""
    return int(requests.agg(F.coalesce(F.max("top_n"), F.lit(0))).first()[0])


def cut(df: DataFrame, group: Sequence[str], order: Sequence[Column], longest: int) -> DataFrame:
    """The first ``top_n`` rows of each group, ``top_n`` being a column of at most ``longest``."""
    return top_per_group(df, group, order, longest).filter(F.col("rank") <= F.col("top_n"))


def diversify(scored: DataFrame, longest: int, max_per_cat: int = MAX_PER_CATEGORY) -> DataFrame:
    """Best first, at most ``max_per_cat`` per category, then the first ``top_n``."""
    capped = top_per_group(scored, ["request_id", "category_id"], best_first(scored), max_per_cat, "_in_category")
    return cut(capped.drop("_in_category"), ["request_id"], best_first(scored), longest)


def trending(scored: DataFrame, longest: int) -> DataFrame:
    """Most played first, with a 0..100 index against the rail's own top."""
    top = cut(scored, ["request_id"], [F.desc("rounds_30d"), F.col("game_title_id")], longest)
    most = F.max("rounds_30d").over(Window.partitionBy("request_id"))
    return top.withColumn("trend_score", trend_index(F.col("rounds_30d"), most))


def because_you_played(scored: DataFrame, longest: int) -> DataFrame:
    """Best of the category of the item last played (``played_category`` of the request)."""
    same = scored.filter(F.col("category_id") == F.col("played_category"))
    return cut(same, ["request_id"], best_first(scored), longest)


def played_category(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Look up the category of each request's ``because_you_played``; unknown items give NULL."""
    played = items.select(
        F.col("game_title_id").alias("because_you_played"), F.col("category_id").alias("played_category")
    )
    return requests.join(played, "because_you_played", "left")


def bests(scored: DataFrame, longest: int, max_per_cat: int = MAX_PER_CATEGORY) -> DataFrame:
    """The best values of each request's candidates by category and bucket, by partial aggregates, without a sort.

    Items are dealt by hash into as many buckets as a rail may hold rows.
    """
    value = F.col(rank_value(scored))
    best = [F.max(value).alias("_value"), F.max("rounds_30d").alias("_rounds")]
    if "played_category" in scored.columns:
        best.append(F.max(F.when(F.col("category_id") == F.col("played_category"), value)).alias("_similar"))
    bucket = F.pmod(F.xxhash64("game_title_id"), F.lit(max(longest, max_per_cat)))
    return scored.groupBy("request_id", "category_id", bucket.alias("_bucket")).agg(*best)


def floors(best: DataFrame, longest: int, max_per_cat: int = MAX_PER_CATEGORY) -> DataFrame:
    """What a candidate must reach to be in a rail, per request and category; NULL where there are too few to tell.

    ``best`` holds the staged ``bests``. Those of different buckets are different rows, so at least n rows reach the
    n-th of them.
    """

    def nth_best(column: str, n: int) -> Column:
        """Of at most buckets x categories values."""
        return F.get(F.sort_array(F.collect_list(column), asc=False), F.lit(n - 1))

    per_request = [nth_best("_rounds", longest).alias("_floor_rounds")]
    if "_similar" in best.columns:
        per_request.append(nth_best("_similar", longest).alias("_floor_similar"))
    in_category = best.groupBy("request_id", "category_id").agg(nth_best("_value", max_per_cat).alias("_floor_in_category"))
    return in_category.join(best.groupBy("request_id").agg(*per_request), "request_id")


def contenders(scored: DataFrame) -> DataFrame:
    """The candidates that reach one of their ``floors``; every row of a rail is among them."""

    def reaches(column: str, floor: str) -> Column:
        return F.coalesce(F.col(column) >= F.col(floor), F.col(floor).isNull())

    value = rank_value(scored)
    some = reaches(value, "_floor_in_category") | reaches("rounds_30d", "_floor_rounds")
    if "_floor_similar" in scored.columns:
        same = F.col("category_id") == F.col("played_category")
        some = some | (same & reaches(value, "_floor_similar"))
    return scored.filter(some).drop(*FLOORS)


def rails(scored: DataFrame, longest: int, max_per_cat: int = MAX_PER_CATEGORY) -> DataFrame:
    """All rails of all requests, one row per (request, rail, rank).

    ``scored`` carries ``top_n`` and, for the third rail, ``played_category``.
    """
    none = F.lit(None).cast("int")
    parts = [
        (RECOMMENDED, diversify(scored, longest, max_per_cat).withColumn("trend_score", none)),
        (TRENDING, trending(scored, longest)),
    ]
    if "played_category" in scored.columns:
        parts.append((SIMILAR, because_you_played(scored, longest).withColumn("trend_score", none)))
    out = None
    for name, part in parts:
        rail = part.withColumn("rail", F.lit(name))
        out = rail if out is None else out.unionByName(rail)
    return out


def cards(railed: DataFrame, items: DataFrame, categories: DataFrame) -> DataFrame:
    """What a page shows of each ranked item. Titles are joined here, to the few rows that were kept."""
    names = items.select("game_title_id", "game_title", "studio_name", "tile_image_url", "tile_color_hex")
    kinds = categories.select("category_id", "category_name", "vertical")
    return (
        railed.join(names, "game_title_id")
        .join(kinds, "category_id")
        .select(
            "request_id",
            "player_id",
            "region_code",
            "rail",
            "rank",
            "game_title_id",
            F.col("game_title").alias("title"),
            F.col("studio_name").alias("studio"),
            F.col("category_name").alias("category"),
            "category_id",
            "vertical",
            F.col("tile_image_url").alias("tile_url"),
            F.col("tile_color_hex").alias("tile_color"),
            card_score(F.col("score")).alias("score"),
            card_score(F.col("score")).alias("model_score"),
            "boosted",
            "trend_score",
            match_percent(F.col("score")).alias("match_pct"),
        )
    )


def trending_in_market(eligible: DataFrame, profile: DataFrame, top_n: int) -> DataFrame:
    """The most played eligible items of each market with their 0..100 index."""
    shown = eligible.filter("is_eligible").select("region_code", "game_title_id")
    played = profile.select("game_title_id", "rounds_30d")
    top = top_per_group(
        shown.join(played, "game_title_id"), ["region_code"], [F.desc("rounds_30d"), F.col("game_title_id")], top_n
    )
    most = F.max("rounds_30d").over(Window.partitionBy("region_code"))
    return top.select(
        "region_code", "rank", "game_title_id", "rounds_30d", trend_index(F.col("rounds_30d"), most).alias("trend_score")
    )
