"""Point-in-time operators over event time: trailing windows and as-of joins.

Both avoid the interval join, which pairs every row with every event of its key, and the
sliding frame, which re-reads the frame for every row. Instead each key's events are cut
into hours: a running aggregate inside the hour, plus one row per hour to carry over. A key
that holds a third of all events is therefore spread over its hours, and the only window
that spans a whole key sees at most one row per hour of the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recloom.functions.scalars import hour_number
from recloom.operators.bounds import BROADCAST_ROWS, fits_broadcast


def _hours_back(ts: Column, hours: int) -> Column:
    return ts - F.make_dt_interval(hours=F.lit(hours)) if hours else ts


def _known(keys: Sequence[str], ts: str) -> Column:
    known = F.col(ts).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def of_spine(events: DataFrame, spine: DataFrame, keys: Sequence[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The events whose key some spine row has; all events, if the spine has more keys than may be broadcast.

    Sums for a bounded sample then read the events of its keys only, and Spark moves this filter below the joins
    that made them. The distinct keys are counted, so a spine that costs much should be staged.
    """
    asked = spine.select(*keys).distinct()
    return events.join(F.broadcast(asked), list(keys), "left_semi") if fits_broadcast(asked, max_rows) else events


def trailing(
    spine: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    ref_ts: str,
    event_ts: str,
    windows: Mapping[str, int],
    measures: Mapping[str, Column],
) -> DataFrame:
    """Sums of ``measures`` over ``[ref - window, ref)`` for every spine row.

    ``windows`` maps a suffix to hours, so ``{"24h": 24}`` and ``{"plays": F.lit(1)}`` add
    ``plays_24h``. The window is half-open: an event at ``ref`` itself never counts, one at
    exactly ``ref - window`` does. Spine rows without events, or without a key, get 0.

    A window sum is the difference of two running sums, one up to ``ref`` and one up to
    ``ref - window``. It depends on the keys and ``ref`` only, so spine rows that share them are
    answered by one probe per boundary.
    """
    names = list(measures)
    hours = sorted({0, *windows.values()})
    boundaries = F.array(
        *[F.struct(F.lit(h).alias("_back"), _hours_back(F.col("_ref"), h).alias("_at")) for h in hours]
    )

    asked = spine.filter(_known(keys, ref_ts)).select(*keys, F.col(ref_ts).alias("_ref")).distinct()
    probes = asked.select(*keys, "_ref", F.explode(boundaries).alias("_edge")).select(*keys, "_ref", "_edge._back", "_edge._at")
    upto = _up_to(probes, events, keys, event_ts, measures)
    parts = []
    for suffix, back in windows.items():
        for n in names:
            total = F.col(n) + F.col(f"_c_{n}")
            signed = F.when(F.col("_back") == 0, total).when(F.col("_back") == back, -total)
            parts.append(F.sum(signed).alias(f"{n}_{suffix}"))
    sums = upto.groupBy(*keys, F.col("_ref").alias(ref_ts)).agg(*parts)
    added = {a: t for a, t in sums.dtypes if a not in (*keys, ref_ts)}
    return spine.join(sums, [*keys, ref_ts], "left").select(
        *spine.columns, *[F.coalesce(a, F.lit(0).cast(t)).alias(a) for a, t in added.items()]
    )


def running(
    spine: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    ref_ts: str,
    event_ts: str,
    edges: Mapping[str, Column],
    measures: Mapping[str, Column],
) -> DataFrame:
    """Sums of ``measures`` over all events of the key before an instant, for every spine row and edge.

    ``edges`` maps a suffix to an instant that depends on ``ref_ts`` only; ``{"now": F.col("ref_ts")}`` and
    ``{"n": F.lit(1)}`` add ``n_now``. Whatever is a difference of such sums needs no interval join: any calendar
    window, and linear weights by way of the sums of a count and of a time. An event at the instant itself does
    not count. Spine rows without events, or without a key, get 0.
    """
    names = list(measures)
    marks = F.array(*[F.struct(F.lit(e).alias("_back"), at.alias("_at")) for e, at in edges.items()])
    asked = spine.filter(_known(keys, ref_ts)).select(*keys, F.col(ref_ts)).distinct()
    probes = asked.select(*keys, F.col(ref_ts).alias("_ref"), F.explode(marks).alias("_edge"))
    upto = _up_to(probes.select(*keys, "_ref", "_edge._back", "_edge._at"), events, keys, event_ts, measures)
    parts = [
        F.sum(F.when(F.col("_back") == e, F.col(n) + F.col(f"_c_{n}"))).alias(f"{n}_{e}") for e in edges for n in names
    ]
    sums = upto.groupBy(*keys, F.col("_ref").alias(ref_ts)).agg(*parts)
    added = {a: t for a, t in sums.dtypes if a not in (*keys, ref_ts)}
    return spine.join(sums, [*keys, ref_ts], "left").select(
        *spine.columns, *[F.coalesce(a, F.lit(0).cast(t)).alias(a) for a, t in added.items()]
    )


def _up_to(
    probes: DataFrame, events: DataFrame, keys: Sequence[str], event_ts: str, measures: Mapping[str, Column]
) -> DataFrame:
    """For probes (keys, _ref, _back, _at) the sums before ``_at``: inside its hour, and ``_c_...`` of earlier hours."""
    names = list(measures)
    # Events at the same instant collapse before anything else is shuffled.
    instants = (
        events.filter(_known(keys, event_ts))
        .select(*keys, F.col(event_ts).alias("_at"), *[col.alias(n) for n, col in measures.items()])
        .groupBy(*keys, "_at")
        .agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("_hour", hour_number(F.col("_at")))
    )
    types = dict(instants.dtypes)
    zero = {n: F.lit(0).cast(types[n]) for n in names}
    probes = probes.select("*", *[zero[n].alias(n) for n in names]).withColumn("_hour", hour_number(F.col("_at")))
    back = dict(probes.dtypes)["_back"]
    line = probes.unionByName(
        instants.withColumns({"_ref": F.lit(None).cast(types["_at"]), "_back": F.lit(None).cast(back)})
    ).withColumn("_event", F.col("_back").isNull().cast("int"))

    # Probes sort ahead of events of the same instant, hence "strictly before".
    inside = Window.partitionBy(*keys, "_hour").orderBy("_at", "_event").rowsBetween(Window.unboundedPreceding, 0)
    in_hour = line.select(
        *keys, "_hour", "_ref", "_back", *[F.sum(n).over(inside).alias(n) for n in names]
    ).filter(F.col("_back").isNotNull())

    hourly = line.groupBy(*keys, "_hour").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hourly.select(
        *keys, "_hour", *[F.coalesce(F.sum(n).over(earlier), zero[n]).alias(f"_c_{n}") for n in names]
    )
    return in_hour.join(carried, [*keys, "_hour"])


def as_of(
    spine: DataFrame,
    view: DataFrame,
    keys: Sequence[str],
    spine_ts: str,
    view_ts: str,
    features: Sequence[str],
    prefix: str = "",
) -> DataFrame:
    """Join to each spine row the newest view row of its key with ``view_ts <= spine_ts``.

    Keeps every spine row; features are NULL before the first view row. Of view rows with
    equal time the one with the largest feature values wins. Spine rows that share key and time
    are answered once.
    """
    payload = F.struct(F.col("_at"), *[F.col(f) for f in features])
    newest = (
        view.filter(_known(keys, view_ts))
        .select(*keys, F.col(view_ts).alias("_at"), *features)
        .groupBy(*keys, "_at")
        .agg(F.max(payload).alias("_value"))
    )
    probes = spine.filter(_known(keys, spine_ts)).select(*keys, F.col(spine_ts).alias("_at")).distinct()
    line = (
        probes.withColumn("_value", F.lit(None).cast(newest.schema["_value"].dataType))
        .withColumn("_probe", F.lit(1))
        .unionByName(newest.withColumn("_probe", F.lit(0)))
        .withColumn("_hour", hour_number(F.col("_at")))
    )
    # Values sort ahead of probes of the same instant, hence "at or before".
    inside = Window.partitionBy(*keys, "_hour").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    in_hour = line.withColumn("_here", F.last("_value", ignorenulls=True).over(inside)).filter("_probe = 1")
    hourly = line.groupBy(*keys, "_hour").agg(F.max("_value").alias("_value"))
    earlier = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hourly.select(*keys, "_hour", F.last("_value", ignorenulls=True).over(earlier).alias("_before"))
    found = in_hour.join(carried, [*keys, "_hour"]).select(
        *keys, F.col("_at").alias(spine_ts), F.coalesce("_here", "_before").alias("_found")
    )
    return spine.join(found, [*keys, spine_ts], "left").select(
        *spine.columns, *[F.col(f"_found.{f}").alias(f"{prefix}{f}") for f in features]
    )


def latest(view: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """The newest row of each key, by partial aggregation instead of a window."""
    rest = [c for c in view.columns if c not in (*keys, ts)]
    newest = view.groupBy(*keys).agg(F.max(F.struct(F.col(ts), *[F.col(c) for c in rest])).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [ts, *rest]]).select(*view.columns)
