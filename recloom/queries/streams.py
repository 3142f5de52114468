"""Structured Streaming over the event files; each stream runs until its input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions.scalars import before, instant
from recloom.plans import recent, recommend
from recloom.plans.scoring import expression_scorer
from recloom.queries.candidates import CANDIDATES, HOURS, LINEAR, context, last_played, recent_rows
from recloom.queries.registry import query
from recloom.session import scratch_path
from recloom.sources.staging import stage
from recloom.sources.star import EVENTS_AS_OF, ROUNDS_AS_OF, SOURCE_SCHEMAS, Star
from recloom.streaming import events as stream_events
from recloom.streaming import keyed, serving, tiles


def event_stream(star: Star) -> DataFrame:
    """The event file as a stream in the shape of the raw events."""
    live = Star(star.spark, star.path)
    source = stream_events.file_stream(star.spark, f"{star.path}/events*.parquet", SOURCE_SCHEMAS["events"])
    live.source = lambda name: source
    return live.events


def finish(running) -> None:
    running.awaitTermination()


def live_tiles(star: Star, keys: list[str]) -> DataFrame:
    path = scratch_path(star.spark, "tiles")
    finish(tiles.start(event_stream(star), keys, f"{path}/rows", f"{path}/state"))
    return tiles.read(star.spark, f"{path}/rows", keys)


def roll(kind: str) -> str:
    """SQL for 24 h and 72 h sums at the reference time."""
    return f"""SELECT {kind}, count(*) FILTER (event_ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOUR) AS plays_24h,
        count(*) AS plays_72h,
        CAST(coalesce(sum(stake_amt) FILTER (event_ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOUR), 0) AS DOUBLE) AS stake_24h,
        CAST(sum(stake_amt) AS DOUBLE) AS stake_72h
        FROM plays WHERE event_type = 'PLAY' AND event_ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 72 HOUR GROUP BY ALL"""


LONG_WINDOWS = {"24h": 24, "72h": 72}


@query("st1_rolling_activity", roll("player_id"))
def st1(star: Star) -> DataFrame:
    return recent.read_tiles(live_tiles(star, tiles.PLAYER), tiles.PLAYER, EVENTS_AS_OF, LONG_WINDOWS)


@query("st2_rolling_categories", roll("player_id, category_id"))
def st2(star: Star) -> DataFrame:
    return recent.read_tiles(
        live_tiles(star, tiles.PLAYER_CATEGORY), tiles.PLAYER_CATEGORY, EVENTS_AS_OF, LONG_WINDOWS
    )


def landed(star: Star, stream: DataFrame) -> DataFrame:
    """Run a stateless stream into a table and read it back."""
    path = scratch_path(star.spark, "raw")
    finish(stream_events.append_raw(stream, f"{path}/rows", f"{path}/state"))
    return star.spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("st3_transform_hook", "SELECT event_id, player_id, event_type FROM plays")
def st3(star: Star) -> DataFrame:
    stream = stream_events.with_hook(event_stream(star), lambda df: df.select("event_id", "player_id", "event_type"))
    return landed(star, stream)


@query(
    "st4_warm_start",
    """SELECT player_id, date_trunc('minute', event_ts) AS minute, count(*) AS plays, CAST(sum(stake_amt) AS DOUBLE) AS stake
       FROM plays WHERE event_type = 'PLAY' AND event_ts >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY ALL""",
)
def st4(star: Star) -> DataFrame:
    """Two days of history, stored as closed tiles, then live tiles from the cut-over on."""
    cutover, path = instant("2024-01-30 00:00:00"), scratch_path(star.spark, "closed")
    two_days = star.events.filter(F.col("event_ts") >= before(EVENTS_AS_OF, days=2))
    tiles.compact(recent.minute_tiles(recent.only_plays(two_days), tiles.PLAYER), path, cutover)
    history = star.spark.read.parquet(path).drop("day")
    warmed = tiles.warm(history, live_tiles(star, tiles.PLAYER), cutover)
    return warmed.withColumn("stake", F.col("stake").cast("double"))


@query("st5_event_gate", "SELECT event_id, game_title_id, category_id FROM plays WHERE event_type = 'PLAY' AND game_title_id IS NOT NULL")
def st5(star: Star) -> DataFrame:
    return landed(star, stream_events.gate(event_stream(star)).select("event_id", "game_title_id", "category_id"))


@query(
    "st6_region_enrichment",
    """SELECT e.event_id, e.player_id, coalesce(r.region_code, 'UK') AS region_code
       FROM plays e LEFT JOIN players p USING (player_id) LEFT JOIN regions r USING (region_id)""",
)
def st6(star: Star) -> DataFrame:
    enriched = stream_events.enrich_region(event_stream(star), star.players, star.regions)
    return landed(star, enriched.select("event_id", "player_id", "region_code"))


@query(
    "st7_online_read_with_fallback",
    f"""SELECT player_id, category_id, count(*) AS plays, CASE WHEN player_id % 2 = 0 THEN 'online' ELSE 'sql' END AS feature_source
        FROM plays WHERE event_type = 'PLAY' AND event_ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL {HOURS} HOUR
          AND event_ts < TIMESTAMP '{EVENTS_AS_OF}' GROUP BY ALL""",
)
def st7(star: Star) -> DataFrame:
    """Even players are served from streamed tiles; the others are unknown there and come from raw events."""
    online = live_tiles(star, tiles.PLAYER_CATEGORY).filter(F.col("player_id") % 2 == 0)
    return recent.recent_categories(online, star.events, EVENTS_AS_OF, HOURS)


@query(
    "st8_feedback_loop",
    CANDIDATES
    + """SELECT request_id, category_id, count(*) AS candidates, bool_or(boosted) AS boosted, max(recent_cat_activity_norm) AS recency
         FROM scored GROUP BY ALL""",
)
def st8(star: Star) -> DataFrame:
    """Events stream into tiles, tiles into the recency feature, and that into the next ranking."""
    online = live_tiles(star, tiles.PLAYER_CATEGORY)
    fresh = stage(recent.recent_categories(online, star.events, EVENTS_AS_OF, HOURS), "recent")
    done = recommend.recommend(
        last_played(star), context(star), expression_scorer(LINEAR), ROUNDS_AS_OF, "linear-check", fresh
    )
    return done.scored.groupBy("request_id", "category_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.bool_or("boosted").alias("boosted"),
        F.max("recent_cat_activity_norm").alias("recency"),
    )


@query(
    "st9_exact_trailing_stream",
    """SELECT s.event_id, count(e.event_id) AS plays_24h FROM plays s
       LEFT JOIN (SELECT * FROM plays WHERE event_type = 'PLAY') e
         ON e.player_id = s.player_id AND e.category_id = s.category_id
        AND e.event_ts >= s.event_ts - INTERVAL 24 HOUR AND e.event_ts < s.event_ts
       WHERE s.event_type = 'PLAY' GROUP BY s.event_id""",
)
def st9(star: Star) -> DataFrame:
    path = scratch_path(star.spark, "exact")
    raw = recent.only_plays(star.events)
    finish(
        tiles.start_exact(
            event_stream(star), lambda low: raw.filter(F.col("event_ts") >= low), f"{path}/rows", f"{path}/state"
        )
    )
    return star.spark.read.parquet(f"{path}/rows").select("event_id", "plays_24h")


@query(
    "st9_corrected_stream",
    """SELECT s.event_id, count(e.event_id) AS plays_24h FROM plays s
       LEFT JOIN (SELECT * FROM plays WHERE event_type = 'PLAY') e
         ON e.player_id = s.player_id AND e.category_id = s.category_id
        AND e.event_ts >= s.event_ts - INTERVAL 24 HOUR AND e.event_ts < s.event_ts
       WHERE s.event_type = 'PLAY' GROUP BY s.event_id""",
)
def st9_corrected(star: Star) -> DataFrame:
    """The events in no order, in several batches, a tenth of them twice: late plays correct the counts they touch."""
    path = scratch_path(star.spark, "corrected")
    raw = star.source("events")
    shuffled = raw.unionByName(raw.filter("event_id % 10 = 0")).repartition(6, F.xxhash64("event_id", "ts") % 97)
    shuffled.write.parquet(f"{path}/events")
    live = Star(star.spark, star.path)
    source = stream_events.file_stream(star.spark, f"{path}/events", SOURCE_SCHEMAS["events"], files_per_trigger=2)
    live.source = lambda name: source
    finish(tiles.start_corrected(live.events, path, f"{path}/state"))
    return tiles.read_corrected(star.spark, path).select("event_id", "plays_24h")


@query(
    "st10_streamed_sketches",
    """SELECT player_id, max(event_ts) AS last_activity_ts, count(DISTINCT game_title_id) AS distinct_items
       FROM plays WHERE event_type = 'PLAY' AND game_title_id IS NOT NULL GROUP BY player_id""",
)
def st10_streamed(star: Star) -> DataFrame:
    """Sketch tiles kept by a stream whose events come in no order, in several batches, merged when read."""
    path = scratch_path(star.spark, "sketches")
    star.source("events").repartition(6, F.xxhash64("event_id") % 97).write.parquet(f"{path}/events")
    live = Star(star.spark, star.path)
    source = stream_events.file_stream(star.spark, f"{path}/events", SOURCE_SCHEMAS["events"], files_per_trigger=2)
    live.source = lambda name: source
    finish(tiles.start_sketches(live.events, tiles.PLAYER, f"{path}/tiles", f"{path}/state"))
    stored = tiles.stored_sketches(star.spark, f"{path}/tiles", tiles.PLAYER)
    return tiles.read_sketches(stored, tiles.PLAYER).select("player_id", "last_activity_ts", "distinct_items")


@query(
    "st10_last_activity_and_items",
    """SELECT player_id, max(event_ts) AS last_activity_ts, count(DISTINCT game_title_id) AS distinct_items
       FROM plays WHERE event_type = 'PLAY' GROUP BY player_id""",
)
def st10(star: Star) -> DataFrame:
    sketches = tiles.distinct_sketch_tiles(recent.only_plays(star.events), tiles.PLAYER)
    return tiles.read_sketches(sketches, tiles.PLAYER)


@query(
    "st11_recommend_on_stream",
    CANDIDATES + "SELECT player_id, rail, CAST(rank AS BIGINT) AS rank, game_title_id FROM railed",
)
def st11(star: Star) -> DataFrame:
    """Requests arrive as files and are answered batch by batch."""
    path = scratch_path(star.spark, "serving")
    asked = last_played(star)
    asked.write.parquet(f"{path}/requests")
    ready, fresh = context(star), stage(recent_rows(star), "recent")
    requests = star.spark.readStream.schema(asked.schema).parquet(f"{path}/requests")

    def answer(batch: DataFrame) -> recommend.Recommendations:
        return recommend.recommend(batch, ready, expression_scorer(LINEAR), ROUNDS_AS_OF, "linear-check", fresh)

    finish(serving.start_recommending(requests, answer, f"{path}/out", f"{path}/state"))
    return star.spark.read.parquet(f"{path}/out/recommendation_output").select(
        "player_id", "rail", "rank", "game_title_id"
    )


@query(
    "mon6_streaming_volume",
    "SELECT date_trunc('day', event_ts) AS period, event_type, count(*) AS rows FROM plays GROUP BY ALL",
)
def mon6(star: Star) -> DataFrame:
    """Daily volume of a streamed log (the events, by type)."""
    path = scratch_path(star.spark, "volume")
    finish(serving.start_volume(event_stream(star), "event_type", f"{path}/rows", f"{path}/state"))
    return keyed.read_newest(
        star.spark, f"{path}/rows", "period TIMESTAMP_NTZ, event_type STRING, rows BIGINT", ["period", "event_type"]
    )


@query("io7_typed_stream_source", "SELECT event_id, ts, user_id, event_type, value FROM events")
def io7(star: Star) -> DataFrame:
    source = stream_events.file_stream(star.spark, f"{star.path}/events*.parquet", SOURCE_SCHEMAS["events"])
    return landed(star, source.select("event_id", "ts", "user_id", "event_type", "value"))


@query("io6_raw_event_append", "SELECT event_id, player_id, event_ts, event_type, game_title_id, category_id, CAST(stake_amt AS DOUBLE) AS stake_amt FROM plays")
def io6(star: Star) -> DataFrame:
    stored = landed(star, event_stream(star))
    return stored.drop("region_code").withColumn("stake_amt", F.col("stake_amt").cast("double"))


