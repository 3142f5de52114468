"""Bulk candidate assembly: requests x the items their market may show, with ranker features.

Everything that belongs to a player (affinity, activity, exclusions) is attached to the
request row, and everything that belongs to a market (eligibility, blocks, popularity) to
the market's item rows. The product then needs no further join: each candidate row is
computed where it is made.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recloom.functions.scalars import RECENCY_CAP, ratio, recency_norm, resolve_region
from recloom.operators.bounds import BROADCAST_ROWS, fits_broadcast
from recloom.operators.ranking import top_per_group
from recloom.plans.eligibility import flag_policies, in_market, region_list
from recloom.plans.features import affinity_map, affinity_of
from recloom.schemas import AFFINITY_COLUMNS
from recloom.session import work_partitions

NORM_SCOPES = ("catalog", "market", "eligible")
TRACE_EXCLUSIONS = 200
# Above what rounding can move a sum of features by while it stays below 1e9 in size.
MARGIN = 1e-6
# A request row is wider than an item's, so fewer of them are broadcast.
FEW_REQUESTS = 20_000
REQUESTS_PER_SALT = 3_000


def resolve_requests(
    requests: DataFrame,
    players: DataFrame,
    regions: DataFrame,
    pattern: str = "^[A-Za-z]{2,5}$",
    default: str = "UK",
) -> DataFrame:
    """Fill in and validate the market of each request."""
    home = players.join(regions.select("region_id", F.col("region_code").alias("_home")), "region_id")
    return (
        requests.join(home.select("player_id", "_home"), "player_id", "left")
        .withColumn("region_code", resolve_region(F.col("region_code"), F.col("_home"), pattern, default))
        .drop("_home")
    )


def attach_player(
    requests: DataFrame,
    affinity: DataFrame,
    behavior: DataFrame,
    categories: DataFrame,
    policies: Mapping[str, DataFrame],
    recent: DataFrame | None = None,
    columns: Mapping[int, str] = AFFINITY_COLUMNS,
    recent_key: str = "player_id",
) -> DataFrame:
    """Add the player's features and exclusions to each request.

    ``recent`` holds plays per ``recent_key`` and category: by player when all requests look at the
    same instant, by request when each has its own.

    The per-player arrays and maps are keyed by catalogue categories (hence the semi joins),
    so none is longer than the category table.
    """
    known = categories.select("category_id")
    shares = affinity.select("player_id", affinity_map(columns).alias("affinities"))
    activity = behavior.select("player_id", F.col("rounds_30d").alias("player_rounds_30d"))
    no_categories = (
        policies["player_category_exclusion"]
        .join(known, "category_id", "left_semi")
        .groupBy("player_id")
        .agg(F.sort_array(F.collect_set("category_id")).alias("excluded_categories"))
    )
    no_subverticals = (
        policies["player_subvertical_exclusion"]
        .join(categories.select("subvertical"), "subvertical", "left_semi")
        .groupBy("player_id")
        .agg(F.sort_array(F.collect_set("subvertical")).alias("excluded_subverticals"))
    )
    out = requests
    for side in (shares, activity, no_categories, no_subverticals):
        out = out.join(side, "player_id", "left")
    if recent is None:
        out = out.withColumn("recent", F.lit(None).cast("map<bigint,bigint>"))
        out = out.withColumn("feature_source", F.lit("sql"))
    else:
        counts = (
            recent.join(known, "category_id", "left_semi")
            .groupBy(recent_key)
            .agg(
                F.map_from_entries(F.sort_array(F.collect_list(F.struct("category_id", "plays")))).alias("recent"),
                F.max("feature_source").alias("feature_source"),
            )
        )
        out = out.join(counts, recent_key, "left").withColumn(
            "feature_source", F.coalesce("feature_source", F.lit("sql"))
        )
    return (
        out.withColumn("player_rounds_30d", F.coalesce("player_rounds_30d", F.lit(0)))
        .withColumn("excluded_categories", F.coalesce("excluded_categories", F.array().cast("array<bigint>")))
        .withColumn("excluded_subverticals", F.coalesce("excluded_subverticals", F.array().cast("array<string>")))
        .withColumn("recent", F.coalesce("recent", F.create_map().cast("map<bigint,bigint>")))
    )


def market_items(
    regions: DataFrame,
    items: DataFrame,
    categories: DataFrame,
    profile: DataFrame,
    policies: Mapping[str, DataFrame],
) -> DataFrame:
    """The items each market may show, with the market rule against them and their features.

    Availability is a silent filter; blocks and category exclusions stay in as ``market_reason``.
    """
    shown = (
        items.filter("available_for_play_yn")
        .select("game_title_id", "category_id", "is_global_yn", "home_region_code", "return_to_player_pct")
        .join(categories.select("category_id", "subvertical"), "category_id")
        .withColumn("region_code", F.explode(region_list(regions)))
        .filter(in_market(F.col("region_code")))
    )
    played = profile.select("game_title_id", "rounds_30d", "ggr_30d_eur", "popularity_trend")
    rated = flag_policies(shown, dict(policies)).join(played, "game_title_id", "left")
    rounds = F.coalesce("rounds_30d", F.lit(0))
    rows = rated.select(
        "region_code",
        "game_title_id",
        "category_id",
        "subvertical",
        rounds.alias("rounds_30d"),
        F.coalesce("ggr_30d_eur", F.lit(0.0)).alias("ggr_30d_eur"),
        F.coalesce("popularity_trend", F.lit(0.0)).alias("popularity_trend"),
        (F.coalesce("return_to_player_pct", F.lit(0)).cast("double") / F.lit(100.0)).alias("rtp_frac"),
        F.when(F.col("is_blocked"), "MARKET_GAME_BLOCK")
        .when(F.col("is_market_excluded"), "MARKET_CATEGORY_EXCLUSION")
        .alias("market_reason"),
    )
    return rows


def market_summary(market: DataFrame, listed: int = TRACE_EXCLUSIONS) -> DataFrame:
    """One row per market: what a trace needs to know without expanding any candidate.

    ``groups`` holds, per category, the size, top popularity and lowest ``listed`` ids of the items
    no market rule removes; ``removed`` the lowest ``listed`` removed items with their reason.
    """
    open_items = market.filter("market_reason IS NULL")
    group = ["region_code", "category_id", "subvertical"]
    lowest = (
        top_per_group(open_items.select(*group, "game_title_id"), group, [F.col("game_title_id")], listed)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list("game_title_id")).alias("lowest"))
    )
    groups = (
        open_items.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("items"), F.max("rounds_30d").alias("most"))
        .join(lowest, group)
        .groupBy("region_code")
        .agg(
            F.sort_array(F.collect_list(F.struct("category_id", "subvertical", "items", "most", "lowest"))).alias(
                "groups"
            )
        )
    )
    closed = market.filter("market_reason IS NOT NULL")
    removed = (
        top_per_group(
            closed.select("region_code", "game_title_id", "market_reason"),
            ["region_code"],
            [F.col("game_title_id")],
            listed,
        )
        .groupBy("region_code")
        .agg(
            F.sort_array(F.collect_list(F.struct("game_title_id", F.col("market_reason").alias("reason")))).alias(
                "removed"
            )
        )
    )
    blocked, excluded = (
        F.col("market_reason") == reason for reason in ("MARKET_GAME_BLOCK", "MARKET_CATEGORY_EXCLUSION")
    )
    totals = market.groupBy("region_code").agg(
        F.count(F.lit(1)).alias("shown_items"),
        F.max("rounds_30d").alias("market_most"),
        # The trace stores a market's whole block list; it is built once per market, not per request.
        F.sort_array(F.collect_set(F.when(blocked, F.col("game_title_id")))).alias("market_game_blocks"),
        F.sort_array(F.collect_set(F.when(excluded, F.col("category_id")))).alias("market_category_exclusions"),
    )
    return totals.join(groups, "region_code", "left").join(removed, "region_code", "left")


def open_groups() -> Column:
    """The groups of the request's market that the player has not excluded."""
    return F.filter(
        F.coalesce("groups", F.array().cast("array<struct<category_id:bigint,subvertical:string,items:bigint,most:bigint,lowest:array<bigint>>>")),
        lambda g: ~F.array_contains("excluded_categories", g["category_id"])
        & ~F.array_contains("excluded_subverticals", g["subvertical"]),
    )


def expand(
    requests: DataFrame,
    market: DataFrame,
    max_broadcast_rows: int = BROADCAST_ROWS,
    asked: DataFrame | None = None,
    on: tuple[str, ...] = ("region_code",),
) -> DataFrame:
    """Pair each request with the items of its market, or those that agree in all of ``on``.

    A small catalogue is broadcast and the requests are spread by ``request_id``, which also serves
    every later per-request window without a shuffle. Of a larger one no part passes the driver: few
    requests are broadcast to its spread rows; many are joined by sorting on (market, salt), where the salt
    splits the requests of a busy market and the catalogue is copied once per salt. Spark takes these copies
    for as small as the catalogue's files, hence the hint. ``asked`` holds as many rows as ``requests`` (a
    request may have several, see ``assemble``) and is counted in its place.
    """
    spark = requests.sparkSession
    width = work_partitions(spark)
    if fits_broadcast(market, max_broadcast_rows):
        return requests.repartition(width, "request_id").join(F.broadcast(market), list(on))
    rows = (requests if asked is None else asked).count()
    if rows <= min(FEW_REQUESTS, max_broadcast_rows):
        return F.broadcast(requests).join(market.repartition(width), list(on))
    salts = min(width, -(-rows // REQUESTS_PER_SALT))
    salted = requests.withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(salts)).cast("int"))
    copies = market.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*on, "_salt"]).drop("_salt")


def catalog_top(catalog: DataFrame | None) -> Column:
    """The most played item of the whole catalogue, at least 1."""
    if catalog is None:
        raise ValueError("norm_scope 'catalog' needs the item profile")
    return F.greatest(catalog.agg(F.max("rounds_30d")).scalar(), F.lit(1))


def heads(market: DataFrame, item_part: str, k: int, catalog_most: Column | None = None) -> DataFrame:
    """The items that can reach a rail of length ``k`` when the rails' order adds an item part to a player part.

    Inside one market and category all candidates of a request share the player's features, so their
    order is that of ``item_part``, an SQL expression over ``game_rounds_30d_norm``,
    ``popularity_trend`` and ``rtp_frac``. Items with equal features have equal scores, so the lowest
    ``k`` ids of each feature combination suffice; of those, the best ``k`` per category stay, and
    whatever lies within ``MARGIN`` of them, because rounding may still swap such neighbours. The
    most played ``k`` per category stay for the trending rail.
    """
    place = ["region_code", "category_id", "subvertical"]
    shape = ["rounds_30d", "popularity_trend", "rtp_frac"]
    open_items = market.filter("market_reason IS NULL")
    if catalog_most is None:
        most = market.groupBy("region_code").agg(F.max("rounds_30d").alias("_most"))
        normed = open_items.join(most, "region_code")
    else:
        normed = open_items.withColumn("_most", catalog_most)
    rated = normed.withColumn(
        "game_rounds_30d_norm", F.coalesce(ratio(F.col("rounds_30d"), F.col("_most")), F.lit(0.0))
    ).withColumn("_part", F.expr(item_part))
    distinct = top_per_group(rated, [*place, *shape], [F.col("game_title_id")], k, "_same")
    best = top_per_group(distinct, place, [F.desc("_part"), F.col("game_title_id")], k, "_nth")
    least = best.groupBy(*place).agg(F.min("_part").alias("_least"))
    by_part = distinct.join(least, place).filter(F.col("_part") >= F.col("_least") - F.lit(MARGIN))
    by_rounds = top_per_group(rated, place, [F.desc("rounds_30d"), F.col("game_title_id")], k, "_nth")
    return by_part.select(*market.columns).unionByName(by_rounds.select(*market.columns)).distinct()


def assemble(
    requests: DataFrame,
    market: DataFrame,
    norm_scope: str = "market",
    columns: Mapping[int, str] = AFFINITY_COLUMNS,
    recency_cap: int = RECENCY_CAP,
    carry: tuple[str, ...] = ("top_n",),
    catalog: DataFrame | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
    shown: DataFrame | None = None,
    floors: DataFrame | None = None,
) -> DataFrame:
    """All candidates of all requests with ranker features and ``excl_reason`` (NULL = keep).

    ``requests`` come from ``attach_player``, ``market`` from ``market_items``; stage the latter
    first, it is read several times. ``norm_scope`` chooses the popularity normaliser: the top of
    the whole ``catalog`` (its item profile; at least 1), the top of what the market shows, or
    the top of what this request keeps. ``shown`` limits the expansion to some of the market's items
    (see ``heads``); normalisers still refer to all of them. ``floors`` (see ``rails.floors``) holds columns by request
    and category that each of their candidates gets.
    """
    if norm_scope not in NORM_SCOPES:
        raise ValueError(f"norm_scope must be one of {NORM_SCOPES}")
    summary = market_summary(market, listed=1).select("region_code", "groups", "market_most")
    wide = requests.join(summary, "region_code", "left")
    if norm_scope == "market":
        most = F.col("market_most")
    elif norm_scope == "eligible":
        most = F.array_max(F.transform(open_groups(), lambda g: g["most"]))
    else:
        most = catalog_top(catalog)
    wide = wide.withColumn("_most", most).drop("groups", "market_most")

    # What a request has in common for all items of a category is worked out before the items are met.
    sold = market.groupBy("region_code").agg(F.sort_array(F.collect_set("category_id")).alias("_categories"))
    category = F.col("category_id")
    plays = F.coalesce(F.col("recent")[category], F.lit(0))
    wide = (
        wide.join(sold, "region_code")
        .withColumn("category_id", F.explode("_categories"))
        .select(
            "request_id",
            "player_id",
            "region_code",
            *carry,
            "category_id",
            "_most",
            "excluded_subverticals",
            F.coalesce(affinity_of(F.col("affinities"), category, columns), F.lit(0.0)).alias("aff_for_category"),
            F.col("player_rounds_30d").cast("double").alias("player_rounds_30d"),
            recency_norm(plays, recency_cap).alias("recent_cat_activity_norm"),
            (plays > 0).alias("boosted"),
            F.array_contains("excluded_categories", category).alias("_excluded"),
        )
    )
    added = []
    if floors is not None:
        added = [c for c in floors.columns if c not in ("request_id", "category_id")]
        wide = wide.join(floors, ["request_id", "category_id"], "left")
    on = ("region_code", "category_id")
    # as many rows as ``wide``: one for each request and category
    asked = requests.join(sold, "region_code").select(F.explode("_categories"))
    return expand(wide, market if shown is None else shown, max_broadcast_rows, asked, on).select(
        "request_id",
        "player_id",
        "region_code",
        *carry,
        "game_title_id",
        "category_id",
        "subvertical",
        "rounds_30d",
        "ggr_30d_eur",
        "aff_for_category",
        ratio(F.col("rounds_30d"), F.col("_most")).alias("game_rounds_30d_norm"),
        "popularity_trend",
        "rtp_frac",
        "player_rounds_30d",
        "recent_cat_activity_norm",
        "boosted",
        F.coalesce(
            F.col("market_reason"),
            F.when(F.col("_excluded"), "PLAYER_CATEGORY_EXCLUSION"),
            F.when(F.array_contains("excluded_subverticals", F.col("subvertical")), "PLAYER_SUBVERTICAL_EXCLUSION"),
        ).alias("excl_reason"),
        *added,
    )


def kept(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("excl_reason").isNull()).drop("excl_reason")


def suppressed(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("excl_reason").isNotNull()).select(
        "request_id", "game_title_id", "category_id", "subvertical", F.col("excl_reason").alias("reason")
    )
