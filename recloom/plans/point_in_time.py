"""Training features as they stood at the time of each row, so that nothing later leaks into them.

Affinity is a share of linearly decaying weights: with age = day of the row - day of the round, a round weighs
``horizon - age`` down to a floor. Summed over the rounds above the floor that is a count times the day of the row
plus the sum of their days, and below it a count; all four are running sums up to one of two instants.
Popularity is that of the midnight before the row, as a daily refresh would have served it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recloom.functions import hashing
from recloom.functions.scalars import RECENCY_CAP, div0, popularity_trend
from recloom.operators.bounds import fits_broadcast
from recloom.operators.trailing import of_spine, running, trailing
from recloom.plans.incremental import Decay
from recloom.plans.training import ATTEMPTS, N_POSITIVES, SEED, negatives, positives, recency_as_of, spine
from recloom.schemas import AFFINITY_COLUMNS, FEATURE_COLS
from recloom.sources.staging import stage


def _day(ts: str) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")


def weights_before(
    rows: DataFrame, events: DataFrame, keys: list[str], ref_ts: str, event_ts: str, name: str, decay: Decay = Decay()
) -> DataFrame:
    """Add the summed recency weight, in hundredth-days, of the events of each row's key before ``ref_ts``."""
    edges = {
        "now": F.col(ref_ts),
        "low": F.date_sub(F.to_date(ref_ts), decay.reach).cast("timestamp_ntz"),
    }
    summed = running(rows, events, keys, ref_ts, event_ts, edges, {"_n": F.lit(1).cast("bigint"), "_d": _day(event_ts)})
    fresh = F.col("_n_now") - F.col("_n_low")
    days = F.col("_d_now") - F.col("_d_low")
    units = fresh * 100 * (decay.horizon - _day(ref_ts)) + days * 100 + F.col("_n_low") * decay.low
    return summed.withColumn(name, units).drop("_n_now", "_n_low", "_d_now", "_d_low")


def affinity_as_of(
    rows: DataFrame,
    events: DataFrame,
    event_ts: str,
    columns: Mapping[int, str] = AFFINITY_COLUMNS,
    decay: Decay = Decay(),
) -> DataFrame:
    """Add ``aff_for_category``: the share of the row's category in its player's weights before ``ref_ts``.

    ``events`` are rounds with the category of their item. A category without a column of its own has the share of
    the first one; a player without earlier rounds has 0.
    """
    asked = F.when(F.col("category_id").isin(*columns), F.col("category_id")).otherwise(F.lit(next(iter(columns))))
    known = events.select("player_id", F.col("category_id").alias("_category"), event_ts)
    named = rows.withColumn("_category", asked.cast("bigint"))
    both = weights_before(named, known, ["player_id", "_category"], "ref_ts", event_ts, "_own", decay)
    both = weights_before(both, known, ["player_id"], "ref_ts", event_ts, "_all", decay)
    return both.withColumn("aff_for_category", div0(F.col("_own"), F.col("_all"))).drop("_category", "_own", "_all")


def per_day(events: DataFrame, event_ts: str) -> DataFrame:
    """(game_title_id, _on, _n): rounds by item and day."""
    dated = events.groupBy("game_title_id", F.to_date(event_ts).alias("_on")).agg(F.count(F.lit(1)).alias("_n"))
    return dated.filter(F.col("_on").isNotNull())


def daily_popularity(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """(day, game_title_id, rounds_30d, rounds_prev_30d) of those ``asked`` (day, game_title_id) with rounds in the
    60 days before.

    What is spread over the days after it is a row of ``per_day``, and only asked items and days leave the task.
    """
    lag = F.explode(F.sequence(F.lit(1), F.lit(60))).alias("_lag")
    spread = of_spine(counted, asked, ["game_title_id"]).select("game_title_id", "_on", "_n", lag)
    spread = spread.select("game_title_id", F.date_add("_on", F.col("_lag")).alias("day"), "_n", "_lag")
    asked = asked.distinct()
    return (
        spread.join(F.broadcast(asked) if fits_broadcast(asked) else asked, ["day", "game_title_id"], "left_semi")
        .groupBy("day", "game_title_id")
        .agg(
            F.sum(F.when(F.col("_lag") <= 30, F.col("_n")).otherwise(0)).alias("rounds_30d"),
            F.sum(F.when(F.col("_lag") > 30, F.col("_n")).otherwise(0)).alias("rounds_prev_30d"),
        )
    )


def daily_most(counted: DataFrame) -> DataFrame:
    """(day, most): the rounds in the 30 days before a day of the most played item, for days after any round.

    The sum of an item changes the day after a round and 30 days later, and is constant in between. Such a stretch
    is covered by two blocks whose length is a power of two, so that the tasks keep a maximum per block and no stretch
    is spread over its days. An item has at most two rows per day of the calendar.
    """
    moves = F.explode(F.array(*[F.struct(F.lit(d).alias("lag"), (F.col("_n") * sign).alias("by")) for d, sign in ((1, 1), (31, -1))]))
    moved = counted.select("game_title_id", "_on", moves.alias("m"))
    moved = moved.groupBy("game_title_id", F.date_add("_on", F.col("m.lag")).alias("day")).agg(F.sum("m.by").alias("by"))
    along = Window.partitionBy("game_title_id").orderBy("day")
    level = F.sum("by").over(along.rowsBetween(Window.unboundedPreceding, 0))
    stretches = moved.select("day", level.alias("most"), F.lead("day").over(along).alias("end")).filter("most > 0")
    bits = F.length(F.bin(F.date_diff("end", "day"))) - 1
    stretches = stretches.select("most", "day", "end", bits.alias("bits"))
    size = F.expr("shiftleft(1, bits)")
    starts = F.explode(F.array(F.col("day"), F.date_sub("end", size))).alias("start")
    blocks = stretches.select("bits", "most", starts).groupBy("bits", "start").agg(F.max("most").alias("most"))
    days = F.explode(F.sequence(F.lit(0), size - 1)).alias("_nth")
    days = blocks.select("most", "start", days).select("most", F.date_add("start", F.col("_nth")).alias("day"))
    return days.groupBy("day").agg(F.max("most").alias("most"))


def popularity_as_of(rows: DataFrame, events: DataFrame, event_ts: str) -> DataFrame:
    """Add ``game_rounds_30d_norm`` (against the most played item of that day) and ``popularity_trend``."""
    dated = rows.withColumn("_day", F.to_date("ref_ts"))
    counted = stage(per_day(events, event_ts), "rounds-by-day")
    popular = daily_popularity(counted, dated.select(F.col("_day").alias("day"), "game_title_id"))
    most = stage(daily_most(counted), "most-played").select(F.col("day").alias("_top_day"), F.col("most").alias("_most"))
    named = popular.select(
        F.col("day").alias("_day"), "game_title_id", F.col("rounds_30d").alias("_now"), F.col("rounds_prev_30d").alias("_ago")
    )
    joined = dated.join(named, ["_day", "game_title_id"], "left").join(most, F.col("_day") == F.col("_top_day"), "left")
    now, ago = F.coalesce("_now", F.lit(0)), F.coalesce("_ago", F.lit(0))
    top = F.greatest(F.coalesce("_most", F.lit(0)), F.lit(1))
    return joined.withColumns(
        {
            "game_rounds_30d_norm": now.cast("double") / top.cast("double"),
            "popularity_trend": popularity_trend(now, ago),
        }
    ).drop("_day", "_top_day", "_now", "_ago", "_most")


def features_as_of(
    rows: DataFrame,
    rounds: DataFrame,
    items: DataFrame,
    columns: Mapping[int, str] = AFFINITY_COLUMNS,
    cap: int = RECENCY_CAP,
    decay: Decay = Decay(),
    event_ts: str = "round_start_timestamp",
) -> DataFrame:
    """Add the six ranker features to rows (player_id, game_title_id, category_id, ref_ts), all as of ``ref_ts``.

    Rounds at ``ref_ts`` or later change nothing; the payout rate of an item is its current one. Rows with an item
    that ``items`` lacks are left out, as in ``training.static_features``.
    """
    kinds = items.select("game_title_id", "category_id")
    # Only popularity looks at all rounds; the rest asks for the players of the rows.
    own = stage(of_spine(rounds, rows, ["player_id"]).select("player_id", "game_title_id", event_ts), "own-rounds")
    events = own.join(kinds, "game_title_id")
    rate = items.select(
        "game_title_id", (F.coalesce("return_to_player_pct", F.lit(0)).cast("double") / F.lit(100.0)).alias("rtp_frac")
    )
    out = recency_as_of(rows.join(rate, "game_title_id"), events, event_ts, cap=cap)
    out = trailing(out, own, ["player_id"], "ref_ts", event_ts, {"30d": 720}, {"_rounds": F.lit(1)})
    out = out.withColumn("player_rounds_30d", F.col("_rounds_30d").cast("double")).drop("_rounds_30d")
    out = affinity_as_of(out, events, event_ts, columns, decay)
    return popularity_as_of(stage(out, "dated-features"), rounds.join(kinds, "game_title_id"), event_ts)


def leak_free_dataset(
    interactions: DataFrame,
    items: DataFrame,
    rounds: DataFrame,
    columns: Mapping[int, str] = AFFINITY_COLUMNS,
    n_pos: int = N_POSITIVES,
    attempts: int = ATTEMPTS,
    seed: int = SEED,
    hasher: hashing.Hasher = hashing.mixed,
    cap: int = RECENCY_CAP,
) -> DataFrame:
    """``training.ranker_dataset`` with every feature as of the row's ``ref_ts``; sample and spine are written once."""
    pos = stage(positives(interactions, n_pos, seed, hasher), "positives")
    rows = stage(spine(pos, negatives(pos, interactions, items, attempts, seed, hasher)), "spine")
    return features_as_of(rows, rounds, items, columns, cap).select(
        "row_id", "player_id", "positive_id", "game_title_id", "category_id", "ref_ts", "label", *FEATURE_COLS
    )
