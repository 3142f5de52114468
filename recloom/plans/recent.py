"""Recent activity: minute tiles, rolling reads of them, and the fallback to raw events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions.scalars import before, instant, minute_start

WINDOWS = {"1h": 1, "24h": 24}


def only_plays(events: DataFrame) -> DataFrame:
    """The gate of the activity features: a PLAY that names an item."""
    return events.filter((F.col("event_type") == "PLAY") & F.col("game_title_id").isNotNull())


def minute_tiles(plays: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plays and stake per key and minute."""
    return plays.groupBy(*keys, minute_start(F.col("event_ts")).alias("minute")).agg(
        F.count("game_title_id").alias("plays"),
        F.sum(F.col("stake_amt").cast("decimal(18,2)")).alias("stake"),
    )


def read_tiles(
    tiles: DataFrame, keys: Sequence[str], as_of: str, windows: Mapping[str, int] = WINDOWS
) -> DataFrame:
    """Rolling sums over the tiles of the last hours before ``as_of`` (a whole minute).

    Only the longest window is scanned; keys without a tile in it have no row.
    """
    minute = F.col("minute")
    longest = max(windows.values())
    inside = {name: minute >= before(as_of, hours=h) for name, h in windows.items()}
    return (
        tiles.filter((minute >= before(as_of, hours=longest)) & (minute < instant(as_of)))
        .groupBy(*keys)
        .agg(
            *[
                F.coalesce(F.sum(F.when(cond, F.col("plays"))), F.lit(0)).alias(f"plays_{name}")
                for name, cond in inside.items()
            ],
            *[
                F.coalesce(F.sum(F.when(cond, F.col("stake"))), F.lit(0)).cast("double").alias(f"stake_{name}")
                for name, cond in inside.items()
            ],
        )
    )


def raw_recent(events: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Plays per player and category straight from the raw events."""
    ts = F.col("event_ts")
    return (
        events.filter(
            (F.col("event_type") == "PLAY")
            & F.col("category_id").isNotNull()
            & (ts >= before(as_of, hours=hours))
            & (ts < instant(as_of))
        )
        .groupBy("player_id", "category_id")
        .agg(F.count(F.lit(1)).alias("plays"))
    )


def recent_categories(tiles: DataFrame, events: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Plays per player and category: the tiles win for every player they know, raw events fill in the rest.

    ``feature_source`` says which of the two a row came from ('online' or 'sql').
    """
    online = (
        read_tiles(tiles, ["player_id", "category_id"], as_of, {"w": hours})
        .filter((F.col("plays_w") > 0) & F.col("category_id").isNotNull())
        .select("player_id", "category_id", F.col("plays_w").alias("plays"), F.lit("online").alias("feature_source"))
    )
    missing = raw_recent(events, as_of, hours).join(online.select("player_id").distinct(), "player_id", "left_anti")
    return online.unionByName(missing.withColumn("feature_source", F.lit("sql")))


def context_activity(requests: DataFrame, behavior: DataFrame) -> DataFrame:
    """Request context weight times the player's 30-day rounds."""
    stored = behavior.select("player_id", "rounds_30d")
    return requests.join(stored, "player_id", "left").select(
        *[requests[c] for c in requests.columns],
        (F.coalesce("rounds_30d", F.lit(0)).cast("double") * F.col("context_weight")).alias(
            "context_adjusted_activity"
        ),
    )
