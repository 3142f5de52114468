"""Bulk registration of new players."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions.scalars import email_hash, instant, local_part, padded_code, stable_uuid
from recloom.operators.ranking import number_rank


def register(
    registrations: DataFrame, players: DataFrame, regions: DataFrame, at: str, default_region_id: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New player rows, their REGISTER events, and the registrations turned away.

    ``registrations`` has ``registration_id`` (a whole number, the order of arrival), ``email``,
    ``region_code`` and ``display_name``. An e-mail is accepted once, for its first registration,
    and only if no player has it. Ids continue after the largest one.
    """
    hashed = registrations.withColumn("email_hash", email_hash(F.col("email")))
    first = hashed.groupBy("email_hash").agg(F.min("registration_id").alias("registration_id"))
    accepted = hashed.join(first, ["email_hash", "registration_id"], "left_semi").join(
        players.select("email_hash"), "email_hash", "left_anti"
    )
    last_id = F.coalesce(players.agg(F.max("player_id")).scalar(), F.lit(0))
    numbered = number_rank(accepted, "registration_id", name="nth").withColumn("player_id", last_id + F.col("nth"))
    regional = numbered.join(regions.select("region_code", "region_id"), "region_code", "left").withColumn(
        "region_id", F.coalesce("region_id", F.lit(default_region_id).cast("bigint"))
    )
    name = F.coalesce("display_name", local_part(F.col("email")))
    new_players = regional.select(
        "registration_id",
        "player_id",
        F.concat(F.lit("ply_"), F.col("player_id").cast("string")).alias("player_source_key"),
        "region_id",
        padded_code("PC", F.col("player_id"), 7).alias("player_code"),
        name.alias("display_name"),
        "email_hash",
        F.lit("CASUAL").alias("player_segment"),
        F.lit(True).alias("is_test_player_yn"),
        instant(at).alias("registration_timestamp"),
        F.lit(True).alias("is_active"),
    )
    events = numbered.select(
        stable_uuid(F.lit("REGISTER"), F.col("player_id")).alias("event_id"),
        "player_id",
        instant(at).alias("event_ts"),
        F.lit("REGISTER").alias("event_type"),
        "region_code",
        stable_uuid(F.lit("session"), F.col("player_id")).alias("session_id"),
    )
    rejected = hashed.join(accepted.select("registration_id"), "registration_id", "left_anti").drop("email_hash")
    return new_players, events, rejected
