"""Column expressions shared by batch, streaming and training plans."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from recloom.functions import hashing

RECENCY_CAP = 10
SESSION_SPACE = 1_000_000_000


def instant(value: str | datetime | Column) -> Column:
    """A zone-less timestamp literal; columns pass through."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def before(value: str | datetime, **delta) -> Column:
    """The literal ``delta`` before ``value``, folded here so that scans can be pruned by it."""
    at = datetime.fromisoformat(value) if isinstance(value, str) else value
    return instant(at - timedelta(**delta))


def div0(num: Column, den: Column) -> Column:
    """Division that gives 0 for a zero divisor and NULL for a NULL operand."""
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num, den).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero divisor."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def flag(col: Column) -> Column:
    """1 for true, else 0 (NULL counts as false)."""
    return F.when(col, F.lit(1)).otherwise(F.lit(0))


def fill_feature(col: Column) -> Column:
    """A missing or not-a-number feature scores as 0.0."""
    value = col.cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def decay_units(days: Column, horizon_days: int = 180, floor: float = 0.05) -> Column:
    """The linear recency weight in hundredth-days: greatest(floor, 1 - days/horizon) x 100 x horizon.

    Integer units keep sums exact and independent of order.
    """
    low = round(floor * horizon_days * 100)
    return F.greatest(F.lit(low).cast("bigint"), (F.lit(horizon_days) - days).cast("bigint") * 100)


def popularity_trend(current: Column, previous: Column) -> Column:
    return current.cast("double") / (previous + 1).cast("double")


def recency_norm(count: Column, cap: int = RECENCY_CAP) -> Column:
    """The capped 24 h activity feature, the same in training, serving and backfill."""
    return F.least(F.coalesce(count, F.lit(0)).cast("double"), F.lit(float(cap))) / F.lit(float(cap))


def match_percent(score: Column) -> Column:
    """Score as a whole percent in 0..100, rounding halves up."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(score * 100 + 0.5))).cast("int")


def trend_index(rounds: Column, most: Column) -> Column:
    """0..100 popularity index inside a rail, rounding halves to even."""
    top = F.when(F.coalesce(most, F.lit(0)) == 0, F.lit(1)).otherwise(most)
    return F.bround(F.lit(100) * (F.coalesce(rounds, F.lit(0)).cast("double") / top.cast("double")), 0).cast("int")


def card_score(score: Column) -> Column:
    return F.bround(F.coalesce(score, F.lit(0.0)), 4)


def resolve_region(asked: Column, home: Column, pattern: str, default: str) -> Column:
    """The asked market, else the player's, else the default; malformed codes fall back to the default."""
    code = F.coalesce(F.when(asked != "", asked), home, F.lit(default))
    return F.when(code.rlike(pattern), code).otherwise(F.lit(default))


def padded_code(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def slug(title: Column, number: Column) -> Column:
    return F.concat(F.lower(F.replace(title, F.lit(" "), F.lit("-"))), F.lit("-"), number.cast("string"))


def clean_slug(text: Column) -> Column:
    """Lower-case words joined by single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def email_hash(email: Column) -> Column:
    return F.sha2(email, 256)


def local_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def daily_session(player: Column, day: Column, hasher: hashing.Hasher = hashing.mixed) -> Column:
    """A session number per player and day."""
    day_number = F.datediff(day, F.lit("1970-01-01").cast("date"))
    return hasher([player, day_number], 0) % SESSION_SPACE


def pick(values: list[str], index: Column) -> Column:
    """The value at ``index`` modulo the list length (0-based)."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def stable_uuid(*parts: Column) -> Column:
    """A reproducible row key; use ``F.uuid()`` where rows need not be replayed."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def hour_number(ts: Column) -> Column:
    """Hours since 1970 of a zone-less timestamp."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    return days.cast("bigint") * 24 + F.hour(ts)


def minute_start(ts: Column) -> Column:
    """``ts`` cut to its minute, staying zone-less."""
    return F.date_trunc("minute", ts).cast("timestamp_ntz")
