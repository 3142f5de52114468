"""The registry behind ``__spark_entry__``: named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recloom.queries.prelude import PRELUDE
from recloom.session import prepare
from recloom.sources.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Runs that several queries start from. None (as for the driver and the bench) repeats them each time;
# the comparison and the tests set a dict to run them once.
SHARED: dict | None = None


def shareable(fn):
    """Let queries over the same tables share the result of ``fn(star, *args)`` while ``SHARED`` is set."""

    def call(star: Star, *args):
        if SHARED is None:
            return fn(star, *args)
        key = (fn.__module__, fn.__name__, star.spark.sparkContext.applicationId, star.path, args)
        if key not in SHARED:
            SHARED[key] = fn(star, *args)
        return SHARED[key]

    return call


def query(name: str, sql: str | None = None):
    """Register ``fn(star) -> DataFrame`` under ``name``; ``sql`` runs over the prelude's tables."""

    def register(fn: Callable[[Star], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, path: fn(Star(prepare(spark), path))
        if sql is not None:
            body = sql.strip()
            ORACLES[name] = PRELUDE + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
        return fn

    return register
