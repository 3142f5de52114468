"""Inference history, its baseline, and daily statistics and drift per market."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recloom.functions import hashing
from recloom.functions.scalars import before, instant
from recloom.operators.ranking import hash_sample, top_per_group
from recloom.operators.selection import quantiles as quantiles_of
from recloom.operators.trailing import of_spine, trailing
from recloom.plans import candidates, traces
from recloom.plans.recommend import Context
from recloom.plans.scoring import Scorer
from recloom.schemas import FEATURE_COLS
from recloom.sources.staging import stage

MONITORED = [*FEATURE_COLS, "score"]
BINS = 10
EPSILON = 1e-6


def backfill_requests(
    players: DataFrame,
    regions: DataFrame,
    today: str,
    days: int = 7,
    per_region: int | None = None,
    seed: int = 42,
    hasher: hashing.Hasher = hashing.mixed,
) -> DataFrame:
    """Backdated requests of all active players, spread over the days by a hash of their ids.

    With ``per_region`` each day scores only the next so many players of every market, lowest ids first.
    ``ref_ts`` lies on the request's day, shifted back by a reproducible 0..20 h and 0..59 min.
    """
    active = players.filter("is_active").join(regions.select("region_id", "region_code"), "region_id")
    pool = active.select("player_id", "region_code")
    if per_region is None:
        slot = (hasher([F.col("player_id")], seed + 2) % days).cast("int")
    else:
        pool = top_per_group(pool, ["region_code"], [F.col("player_id")], days * per_region, "nth")
        slot = F.floor((F.col("nth") - 1) / F.lit(per_region)).cast("int")
    back = F.make_dt_interval(
        (F.lit(days) - slot).cast("int"),
        (hasher([F.col("player_id")], seed) % 21).cast("int"),
        (hasher([F.col("player_id")], seed + 1) % 60).cast("int"),
    )
    return pool.select(
        F.concat_ws("@", "player_id", slot).alias("request_id"),
        "player_id",
        "region_code",
        F.lit(1).alias("top_n"),
        (instant(today) - back).alias("ref_ts"),
        slot.alias("slot"),
    )


def recent_before(
    requests: DataFrame, rounds: DataFrame, items: DataFrame, categories: DataFrame, hours: int = 24
) -> DataFrame:
    """Rounds per request and category in the ``hours`` before the request's own ``ref_ts``.

    Only rounds that some request may look at are read: none outside the span of all windows and, if the requests
    have few players, none of others.
    """
    ids = F.sort_array(F.collect_set("category_id"))
    asked = stage(requests.select("request_id", "player_id", "ref_ts"), "asked")
    spine = asked.select("*", F.explode(categories.agg(ids).scalar()).alias("category_id"))
    first = asked.agg(F.min("ref_ts") - F.make_dt_interval(hours=F.lit(hours))).scalar()
    last = asked.agg(F.max("ref_ts")).scalar()
    at = F.col("round_start_timestamp")
    events = of_spine(rounds.filter((at >= first) & (at < last)), asked, ["player_id"]).join(
        items.select("game_title_id", "category_id"), "game_title_id"
    )
    # both running sums read them
    events = stage(events.select("player_id", "category_id", "round_start_timestamp"), "asked-rounds")
    return (
        trailing(
            spine, events, ["player_id", "category_id"], "ref_ts", "round_start_timestamp",
            {"recent": hours}, {"plays": F.lit(1)},
        )
        .filter("plays_recent > 0")
        .select("request_id", "category_id", F.col("plays_recent").alias("plays"), F.lit("sql").alias("feature_source"))
    )


def backfill_ready(requests: DataFrame, context: Context, recent: DataFrame) -> DataFrame:
    """Backdated requests with the features and exclusions of their players, staged."""
    return stage(
        candidates.attach_player(
            requests, context.affinity, context.behavior, context.categories, context.policies, recent,
            context.columns, recent_key="request_id",
        ),
        "backfill",
    )


def backfill_log(requests: DataFrame, context: Context, scorer: Scorer, recent: DataFrame) -> DataFrame:
    """Score every candidate of backdated requests as of their time, in one job."""
    return score_backfill(backfill_ready(requests, context, recent), context, scorer)


def score_backfill(ready: DataFrame, context: Context, scorer: Scorer) -> DataFrame:
    """``backfill_log`` of requests that are ready."""
    assembled = candidates.assemble(
        ready, context.market, "eligible", context.columns, carry=("top_n", "ref_ts", "slot")
    )
    return scorer(candidates.kept(assembled))


def log_rows(scored: DataFrame) -> DataFrame:
    return traces.inference_rows(scored, F.col("ref_ts"))


def first_logged(ready: DataFrame, market: DataFrame, unit: str = "day") -> Column:
    """The earliest day of the log of ``ready`` requests, without expanding their candidates.

    A request has rows in the log if its market has an item that neither a market rule nor its player excludes.
    """
    group = F.struct("category_id", "subvertical")
    shown = market.filter("market_reason IS NULL").groupBy("region_code").agg(F.collect_set(group).alias("_groups"))
    barred = lambda name, value: F.coalesce(F.array_contains(name, value), F.lit(False))
    logged = F.exists(
        "_groups",
        lambda g: ~barred("excluded_categories", g["category_id"]) & ~barred("excluded_subverticals", g["subvertical"]),
    )
    return ready.join(shown, "region_code").filter(logged).agg(F.min(F.date_trunc(unit, "ref_ts"))).scalar()


def baseline(
    log: DataFrame, keys: Sequence[str], rows: int | None = None, seed: int = 42,
    hasher: hashing.Hasher = hashing.mixed, unit: str = "day", first: Column | None = None,
) -> DataFrame:
    """The earliest day of the log, or a reproducible sample of at most ``rows`` of its rows.

    A log that is not stored would be worked out for its ``first`` day alone, unless that is given.
    """
    if first is None:
        first = log.agg(F.min(F.date_trunc(unit, "event_ts"))).scalar()
    day = log.filter(F.date_trunc(unit, "event_ts") == first)
    return day if rows is None else hash_sample(day, keys, rows, seed, hasher)


def volume(log: DataFrame, segment: str = "region_code", unit: str = "day") -> DataFrame:
    """Rows per period and segment."""
    return log.groupBy(F.date_trunc(unit, "event_ts").cast("timestamp_ntz").alias("period"), segment).agg(
        F.count(F.lit(1)).alias("rows")
    )


def long_form(log: DataFrame, columns: Sequence[str], segment: str, unit: str) -> DataFrame:
    """One row per logged value: (period, segment, metric, value); a NaN counts as missing."""
    return log.select(
        F.date_trunc(unit, "event_ts").cast("timestamp_ntz").alias("period"),
        segment,
        *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns],
    ).unpivot(["period", segment], list(columns), "metric", "value")


def statistics(
    log: DataFrame, columns: Sequence[str] = tuple(MONITORED), segment: str = "region_code", unit: str = "day"
) -> DataFrame:
    """Count, nulls, mean, deviation and range per period, segment and column, for values of any size."""
    return (
        long_form(log, columns, segment, unit)
        .groupBy("period", segment, "metric")
        .agg(
            F.count("value").alias("n"),
            F.count_if(F.col("value").isNull()).alias("nulls"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("deviation"),
        )
    )


def quantiles(
    log: DataFrame,
    columns: Sequence[str] = tuple(MONITORED),
    points: Mapping[str, float] | None = None,
    segment: str = "region_code",
    unit: str = "day",
) -> DataFrame:
    """Approximate quantiles per period, segment and column (mergeable sketches, no sort)."""
    points = points or {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    return (
        long_form(log, columns, segment, unit)
        .groupBy("period", segment, "metric")
        .agg(*[F.percentile_approx("value", q, 10_000).alias(name) for name, q in points.items()])
    )


def bin_edges(base: DataFrame, columns: Sequence[str], segment: str, bins: int = BINS) -> DataFrame:
    """Inner bin edges per segment and column: the baseline's exact quantiles."""
    inner = [i / bins for i in range(1, bins)]
    values = base.select(segment, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [segment], list(columns), "metric", "value"
    )
    edges = quantiles_of(values, "value", inner, [segment, "metric"])
    return edges.select(segment, "metric", *[F.col("quantiles")[i].alias(f"edge_{i}") for i in range(bins - 1)])


def histogram(
    long: DataFrame, edges: DataFrame, groups: Sequence[str], segment: str, bins: int = BINS
) -> DataFrame:
    """Rows per bin; bin ``b`` holds values above ``b`` of the edges."""
    binned = sum((F.col("value") > F.col(f"edge_{i}")).cast("int") for i in range(bins - 1))
    return (
        long.filter(F.col("value").isNotNull())
        .join(edges, [segment, "metric"])
        .groupBy(*groups, "metric", binned.alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def drift(
    log: DataFrame,
    base: DataFrame,
    columns: Sequence[str] = tuple(MONITORED),
    segment: str = "region_code",
    unit: str = "day",
    bins: int = BINS,
    epsilon: float = EPSILON,
) -> DataFrame:
    """Population stability index and binned KS distance to the baseline.

    The log is only counted into the baseline's bins: its partial counts are all that is shuffled.
    Shares are floored at ``epsilon`` so that empty bins stay finite. Segments without a baseline
    have no row.
    """
    edges = stage(bin_edges(base, columns, segment, bins), "edges")
    current = histogram(long_form(log, columns, segment, unit), edges, ["period", segment], segment, bins)
    return drift_of_counts(current, base_histogram(base, edges, columns, segment, bins), segment, bins, epsilon)


def base_histogram(
    base: DataFrame, edges: DataFrame, columns: Sequence[str], segment: str, bins: int = BINS
) -> DataFrame:
    """The baseline counted into its own bins."""
    old = base.select(segment, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [segment], list(columns), "metric", "value"
    )
    return histogram(old, edges, [segment], segment, bins)


def drift_of_counts(
    current: DataFrame, reference: DataFrame, segment: str, bins: int = BINS, epsilon: float = EPSILON
) -> DataFrame:
    """``drift`` from rows per bin (period, segment, metric, bin, rows) and those of the baseline.

    Counts of the same bin add up, so they may come from any number of batches.
    """

    def shares(counts: DataFrame, groups: Sequence[str], name: str) -> DataFrame:
        """An array of ``bins`` shares per group."""
        per_bin = counts.groupBy(*groups).agg(
            F.sum("rows").alias("_all"),
            *[F.sum(F.when(F.col("bin") == b, F.col("rows")).otherwise(0)).alias(f"_{b}") for b in range(bins)],
        )
        total = F.col("_all").cast("double")
        return per_bin.select(
            *groups,
            F.col("_all").alias(f"{name}_rows"),
            F.array(*[F.col(f"_{b}").cast("double") / total for b in range(bins)]).alias(name),
        )

    new_shares = shares(current, ["period", segment, "metric"], "current")
    old_shares = shares(reference, [segment, "metric"], "reference")
    return distances(new_shares.join(old_shares, [segment, "metric"]), segment, epsilon)


def distances(shares: DataFrame, segment: str, epsilon: float = EPSILON) -> DataFrame:
    """PSI and binned KS distance of arrays of shares, ``current`` against ``reference``."""
    floor = F.lit(epsilon)

    def term(pair):
        p, q = F.greatest(pair["reference"], floor), F.greatest(pair["current"], floor)
        return (q - p) * F.ln(q / p)

    def ks_step(state, pair):
        gap = state["gap"] + pair["current"] - pair["reference"]
        return F.struct(gap.alias("gap"), F.greatest(state["ks"], F.abs(gap)).alias("ks"))

    pairs = F.arrays_zip("current", "reference")
    start = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("ks"))
    return shares.select(
        "period",
        segment,
        "metric",
        F.col("current_rows").alias("rows"),
        "reference_rows",
        F.aggregate(F.transform(pairs, term), F.lit(0.0), lambda a, b: a + b).alias("psi"),
        F.aggregate(pairs, start, ks_step, lambda s: s["ks"]).alias("ks"),
    )


def since(log: DataFrame, as_of: str, days: int) -> DataFrame:
    """The part of the log a monitor refresh still has to look at."""
    return log.filter((F.col("event_ts") >= before(as_of, days=days)) & (F.col("event_ts") < instant(as_of)))
