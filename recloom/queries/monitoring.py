"""Backdated scoring, volume, statistics and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recloom.functions import hashing
from recloom.plans import monitor, sketches
from recloom.plans.scoring import expression_scorer
from recloom.queries.candidates import LINEAR, LINEAR_SQL, context
from recloom.queries.prelude import candidate_rows, normed_rows
from recloom.queries.registry import query, shareable
from recloom.session import scratch_path
from recloom.sources.staging import stage
from recloom.sources.star import ROUNDS_AS_OF, Star
from recloom.streaming import monitoring as stream_monitoring

DAYS, PER_REGION = 7, 2


def backfill_requests(star: Star, per_region: int | None = PER_REGION) -> DataFrame:
    return monitor.backfill_requests(
        star.players, star.regions, ROUNDS_AS_OF, DAYS, per_region, hasher=hashing.portable
    )


@shareable
def backfill(star: Star, per_region: int | None = PER_REGION) -> tuple[DataFrame, Column]:
    """The scored log of backdated requests, and its first day."""
    requests = backfill_requests(star, per_region)
    recent = monitor.recent_before(requests, star.rounds, star.items, star.categories)
    around = context(star)
    ready = monitor.backfill_ready(requests, around, recent)
    log = monitor.score_backfill(ready, around, expression_scorer(LINEAR))
    return log, monitor.first_logged(ready, around.market)


def backfilled(star: Star, *per_region: int | None) -> DataFrame:
    return backfill(star, *per_region)[0]


BACKFILL = f"""
WITH pool AS (
  SELECT player_id, region_code, nth FROM (
    SELECT player_id, region_code, row_number() OVER (PARTITION BY region_code ORDER BY player_id) AS nth
    FROM players JOIN regions USING (region_id) WHERE players.is_active) WHERE nth <= {DAYS * PER_REGION}
), backdated AS (
  SELECT player_id || '@' || ((nth - 1) // {PER_REGION}) AS request_id, player_id, region_code,
         CAST((nth - 1) // {PER_REGION} AS INTEGER) AS slot,
         TIMESTAMP '{ROUNDS_AS_OF}' - to_days(CAST({DAYS} - (nth - 1) // {PER_REGION} AS INTEGER))
           - to_hours({hashing.portable_sql(["player_id"], 42)} % 21) - to_minutes({hashing.portable_sql(["player_id"], 43)} % 60) AS ref_ts
  FROM pool
), recent AS (
  SELECT q.request_id, i.category_id, count(*) AS plays FROM backdated q JOIN rounds f ON f.player_id = q.player_id
    AND f.ts >= q.ref_ts - INTERVAL 24 HOUR AND f.ts < q.ref_ts JOIN items i USING (game_title_id) GROUP BY ALL
), {candidate_rows("backdated", "request_id")}, allowed AS (
  FROM candidates WHERE excl_reason IS NULL
), logged AS (
  SELECT *, {LINEAR_SQL} AS score FROM ({normed_rows("allowed")})
)
"""

# The same over all active players, each on one day.
BACKFILL_ALL = f"""
WITH pool AS (
  SELECT player_id, region_code, CAST({hashing.portable_sql(["player_id"], 44)} % {DAYS} AS INTEGER) AS slot
  FROM players JOIN regions USING (region_id) WHERE players.is_active
), backdated AS (
  SELECT player_id || '@' || slot AS request_id, player_id, region_code, slot,
         TIMESTAMP '{ROUNDS_AS_OF}' - to_days(CAST({DAYS} - slot AS INTEGER))
           - to_hours({hashing.portable_sql(["player_id"], 42)} % 21) - to_minutes({hashing.portable_sql(["player_id"], 43)} % 60) AS ref_ts
  FROM pool
""" + BACKFILL[BACKFILL.index("), recent AS (") :]

LOG = [
    "request_id", "game_title_id", "ref_ts", "region_code", "aff_for_category", "game_rounds_30d_norm",
    "popularity_trend", "rtp_frac", "player_rounds_30d", "recent_cat_activity_norm", "score",
]


@query(
    "mon1_backfill_log_all_players",
    BACKFILL_ALL
    + """SELECT request_id, game_title_id, ref_ts, region_code, aff_for_category,
         coalesce(game_rounds_30d_norm, 0) AS game_rounds_30d_norm, popularity_trend, rtp_frac, player_rounds_30d,
         recent_cat_activity_norm, score FROM logged""",
)
def mon1_all(star: Star) -> DataFrame:
    return backfilled(star, None).select(*LOG)


@query(
    "mon2_baseline_all_players",
    BACKFILL_ALL
    + """SELECT request_id, game_title_id, region_code, score FROM logged
         WHERE date_trunc('day', ref_ts) = (SELECT min(date_trunc('day', ref_ts)) FROM logged)""",
)
def mon2_all(star: Star) -> DataFrame:
    log, first = backfill(star, None)
    log = log.withColumn("event_ts", F.col("ref_ts"))
    return monitor.baseline(log, ["player_id", "game_title_id"], first=first).select(
        "request_id", "game_title_id", "region_code", "score"
    )


@query(
    "mon1_backfill_log",
    BACKFILL
    + """SELECT request_id, game_title_id, ref_ts, region_code, aff_for_category,
         coalesce(game_rounds_30d_norm, 0) AS game_rounds_30d_norm, popularity_trend, rtp_frac, player_rounds_30d,
         recent_cat_activity_norm, score FROM logged""",
)
def mon1(star: Star) -> DataFrame:
    return backfilled(star).select(
        "request_id", "game_title_id", "ref_ts", "region_code", "aff_for_category", "game_rounds_30d_norm",
        "popularity_trend", "rtp_frac", "player_rounds_30d", "recent_cat_activity_norm", "score",
    )


@query(
    "mon2_baseline",
    BACKFILL
    + """SELECT request_id, game_title_id, region_code, score FROM logged
         WHERE date_trunc('day', ref_ts) = (SELECT min(date_trunc('day', ref_ts)) FROM logged)""",
)
def mon2(star: Star) -> DataFrame:
    log, first = backfill(star)
    log = log.withColumn("event_ts", F.col("ref_ts"))
    return monitor.baseline(log, ["player_id", "game_title_id"], first=first).select(
        "request_id", "game_title_id", "region_code", "score"
    )


@query(
    "mon3_daily_volume",
    BACKFILL + "SELECT date_trunc('day', ref_ts) AS period, region_code, count(*) AS rows FROM logged GROUP BY ALL",
)
def mon3(star: Star) -> DataFrame:
    return monitor.volume(monitor.log_rows(backfilled(star)))


METRICS = ["price", "discount", "quantity"]

LOGGED = """
WITH log AS (
  SELECT date_trunc('month', l_shipdate) AS period, r.region_code, l_extendedprice AS price, l_discount AS discount,
         CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity, l_orderkey, l_linenumber, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN players p ON p.player_id = o_custkey JOIN regions r USING (region_id)
), long AS (
  SELECT period, region_code, 'price' AS metric, price AS value FROM log
  UNION ALL SELECT period, region_code, 'discount', discount FROM log
  UNION ALL SELECT period, region_code, 'quantity', quantity FROM log
)
"""


def order_log(star: Star) -> DataFrame:
    """Order lines as a log of three measured columns per month and market; some quantities are missing.

    Orders find their market first, so the lines are shuffled by order only and not by player too.
    """
    home = star.players.select("player_id", "region_id").join(star.regions.select("region_id", "region_code"), "region_id")
    orders = star.source("orders").join(home, F.col("o_custkey") == F.col("player_id")).select("o_orderkey", "region_code")
    return (
        star.source("lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_shipdate").alias("event_ts"),
            "region_code",
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"),
        )
    )


@query(
    "mon4_statistics",
    LOGGED
    + """SELECT period, region_code, metric, count(value) AS n, count(*) - count(value) AS nulls, min(value) AS low,
         max(value) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM long GROUP BY ALL""",
)
def mon4(star: Star) -> DataFrame:
    told = monitor.statistics(order_log(star), METRICS, unit="month")
    return told.withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query("mon4_quantiles")
def mon4_quantiles(star: Star) -> DataFrame:
    return monitor.quantiles(order_log(star), METRICS, unit="month")


def first_year(star: Star) -> DataFrame:
    return order_log(star).filter(F.col("event_ts") < "1995-07-01")


HISTOGRAM = LOGGED + """, base AS (
  SELECT region_code, metric, value FROM long WHERE period < TIMESTAMP '1995-07-01 00:00:00'
), edges AS (
  SELECT region_code, metric, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM base GROUP BY ALL
), binned AS (
  SELECT l.period, l.region_code, l.metric, len(list_filter(e, lambda x: l.value > x)) AS bin
  FROM long l JOIN edges USING (region_code, metric) WHERE l.value IS NOT NULL
), reference AS (
  SELECT b.region_code, b.metric, len(list_filter(e, lambda x: b.value > x)) AS bin, count(*) AS rows
  FROM base b JOIN edges USING (region_code, metric) WHERE b.value IS NOT NULL GROUP BY ALL
), groups AS (
  SELECT period, region_code, metric, count(*) AS total FROM binned GROUP BY ALL
), base_totals AS (
  SELECT region_code, metric, CAST(sum(rows) AS BIGINT) AS base_total FROM reference GROUP BY ALL
), shares AS (
  SELECT g.period, g.region_code, g.metric, g.total, t.base_total, b.bin,
         CAST(coalesce(c.rows, 0) AS DOUBLE) / g.total AS q, CAST(coalesce(r.rows, 0) AS DOUBLE) / t.base_total AS p
  FROM groups g JOIN base_totals t USING (region_code, metric), range(10) b(bin)
  LEFT JOIN (SELECT period, region_code, metric, bin, count(*) AS rows FROM binned GROUP BY ALL) c
    ON c.period = g.period AND c.region_code = g.region_code AND c.metric = g.metric AND c.bin = b.bin
  LEFT JOIN reference r ON r.region_code = g.region_code AND r.metric = g.metric AND r.bin = b.bin
)
"""


def drift(star: Star) -> DataFrame:
    return monitor.drift(order_log(star), first_year(star), METRICS, unit="month")


@query(
    "mon5_psi",
    HISTOGRAM
    + """SELECT period, region_code, metric, any_value(total) AS rows, any_value(base_total) AS reference_rows,
         round(sum((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6))), 6) AS psi
       FROM shares GROUP BY period, region_code, metric""",
)
def mon5(star: Star) -> DataFrame:
    return drift(star).drop("ks").withColumn("psi", F.round("psi", 6))


@query(
    "mon5_ks",
    HISTOGRAM
    + """SELECT period, region_code, metric, round(max(abs(gap)), 6) AS ks FROM (
         SELECT *, sum(q - p) OVER (PARTITION BY period, region_code, metric ORDER BY bin) AS gap FROM shares)
       GROUP BY period, region_code, metric""",
)
def mon5_ks(star: Star) -> DataFrame:
    return drift(star).select("period", "region_code", "metric", F.round("ks", 6).alias("ks"))


# The monitors over the inference log itself: all active players, the six features and the score.
LOG_LONG = BACKFILL_ALL + """, long AS (
  SELECT date_trunc('day', ref_ts) AS period, region_code, v.metric, v.value
  FROM logged, LATERAL (VALUES ('aff_for_category', aff_for_category), ('game_rounds_30d_norm', coalesce(game_rounds_30d_norm, 0)),
    ('popularity_trend', popularity_trend), ('rtp_frac', rtp_frac), ('player_rounds_30d', player_rounds_30d),
    ('recent_cat_activity_norm', recent_cat_activity_norm), ('score', score)) v(metric, value)
)
"""
LOG_DRIFT = LOG_LONG + HISTOGRAM[HISTOGRAM.index(", base AS (") :].replace(
    "FROM long WHERE period < TIMESTAMP '1995-07-01 00:00:00'", "FROM long WHERE period = (SELECT min(period) FROM long)"
)
DRIFT_ROWS = """SELECT period, region_code, metric, any_value(total) AS rows, any_value(base_total) AS reference_rows,
         round(sum((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6))), 6) AS psi,
         round(max(abs(gap)), 6) AS ks
       FROM (SELECT *, sum(q - p) OVER (PARTITION BY period, region_code, metric ORDER BY bin) AS gap FROM shares)
       GROUP BY period, region_code, metric"""
# A rank may be off by so many times the error that holds in 99 of 100 cases.
SURE = 3


@shareable
def inference_log(star: Star) -> DataFrame:
    return stage(monitor.log_rows(backfilled(star, None)), "inference-log")


def kept_profiles(star: Star, log: DataFrame) -> DataFrame:
    """Profiles of the log, stored in three batches and merged from there."""
    root = scratch_path(star.spark, "profiles")
    parts = F.pmod(F.xxhash64("row_id"), F.lit(3))
    for k in range(3):
        sketches.store(sketches.profile(log.filter(parts == k)), root, f"part-{k}")
    return stage(sketches.merged(sketches.stored(star.spark, root)), "merged-profiles")


def first_day(log: DataFrame) -> DataFrame:
    return monitor.baseline(log, ["row_id"])


@query(
    "mon4_log_statistics",
    LOG_LONG
    + """SELECT period, region_code, metric, count(value) AS n, count(*) - count(value) AS nulls, min(value) AS low,
         max(value) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM long GROUP BY ALL""",
)
def mon4_log(star: Star) -> DataFrame:
    told = sketches.statistics(kept_profiles(star, inference_log(star)))
    return told.withColumnRenamed("segment", "region_code").withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query(
    "mon4_log_quantiles",
    LOG_LONG
    + "SELECT period, region_code, metric, count(value) AS n, TRUE AS p05_close, TRUE AS p50_close, TRUE AS p95_close FROM long GROUP BY ALL",
)
def mon4_log_quantiles(star: Star) -> DataFrame:
    """Quantiles read from stored sketches, and whether their true ranks in the log are as close as stated."""
    log, points = inference_log(star), {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    read = sketches.quantiles(kept_profiles(star, log), points).withColumnRenamed("segment", "region_code")
    keys, error = ["period", "region_code", "metric"], SURE * sketches.rank_error()
    both = monitor.long_form(log, monitor.MONITORED, "region_code", "day").join(read, keys)
    below = {c: F.count_if(F.col("value") < F.col(c)) / F.count("value") for c in points}
    upto = {c: F.count_if(F.col("value") <= F.col(c)) / F.count("value") for c in points}
    close = [((below[c] - error <= q) & (upto[c] + error >= q)).alias(f"{c}_close") for c, q in points.items()]
    return both.groupBy(*keys).agg(F.max("n").alias("n"), *close)


@query("mon5_log_drift", LOG_DRIFT + DRIFT_ROWS)
def mon5_log(star: Star) -> DataFrame:
    """The log against its first day, by exact edges and counts."""
    log = inference_log(star)
    return monitor.drift(log, first_day(log)).withColumns({c: F.round(c, 6) for c in ("psi", "ks")})


@query(
    "mon5_log_sketch_drift",
    LOG_DRIFT
    + "SELECT period, region_code, metric, any_value(total) AS rows, any_value(base_total) AS reference_rows, TRUE AS ks_close FROM shares GROUP BY ALL",
)
def mon5_log_sketches(star: Star) -> DataFrame:
    """Drift from stored sketches alone, and whether it is as close as stated to counting the log in the same bins."""
    log = inference_log(star)
    base = stage(sketches.profile(first_day(log)), "baseline-profile")
    read = sketches.drift(kept_profiles(star, log), base).withColumnRenamed("segment", "region_code")
    marks = sketches.edges(base).select(
        F.col("segment").alias("region_code"), "metric", *[F.col("edges")[i].alias(f"edge_{i}") for i in range(monitor.BINS - 1)]
    )
    marks = stage(marks, "sketched-edges")
    long = monitor.long_form(log, monitor.MONITORED, "region_code", "day")
    counts = monitor.histogram(long, marks, ["period", "region_code"], "region_code")
    exact = monitor.drift_of_counts(counts, monitor.base_histogram(first_day(log), marks, monitor.MONITORED, "region_code"), "region_code")
    keys = ["period", "region_code", "metric"]
    both = read.join(exact.select(*keys, F.col("ks").alias("counted")), keys)
    close = F.abs(F.col("ks") - F.col("counted")) <= 2 * (SURE * sketches.rank_error() + 1 / sketches.GRID)
    return both.select(*keys, "rows", "reference_rows", close.alias("ks_close"))


@query("mon6_streaming_drift", LOG_DRIFT + DRIFT_ROWS)
def mon6_drift(star: Star) -> DataFrame:
    """The log streamed in several batches against the stored baseline; days are reported once they are over."""
    log, root = inference_log(star), scratch_path(star.spark, "monitor")
    stream_monitoring.store_baseline(first_day(log), root)
    path = f"{root}/log"
    log.repartition(4, "row_id").write.parquet(path)
    stream = star.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(path)
    stream_monitoring.start_monitoring(stream, root, f"{root}/state").awaitTermination()
    told = stream_monitoring.closed_drift(star.spark, root, ROUNDS_AS_OF)
    return told.withColumnRenamed("segment", "region_code").withColumns({c: F.round(c, 6) for c in ("psi", "ks")})
