"""Training sets, models and their evaluation. Data stays in DataFrames until ``fit``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Matrices
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions import hashing
from recloom.functions.scalars import RECENCY_CAP, fill_feature, ratio, recency_norm
from recloom.operators import boosting
from recloom.operators.ranking import auc, hash_rank, hash_sample
from recloom.operators.selection import quantiles
from recloom.operators.trailing import of_spine, trailing
from recloom.plans.features import affinity_map, affinity_of
from recloom.schemas import AFFINITY_COLUMNS, FEATURE_COLS
from recloom.sources.staging import stage

N_POSITIVES = 60_000
ATTEMPTS = 5
SEED = 42
TREES = {"maxIter": 120, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"}
# Minus infinity cannot be read back from a saved model's parameters.
NO_BOUND = -1e300
PROPENSITY_EXTRA = ["rounds_30d", "avg_stake_eur", "days_since_last_play"]


def positives(
    interactions: DataFrame, n: int | None = N_POSITIVES, seed: int = SEED, hasher: hashing.Hasher = hashing.mixed
) -> DataFrame:
    """A reproducible sample of ``n`` played (player, item) pairs; all of them without ``n``."""
    if n is None:
        return interactions
    return hash_sample(interactions, ["player_id", "game_title_id"], n, seed, hasher)


def negatives(
    pos: DataFrame,
    interactions: DataFrame,
    items: DataFrame,
    attempts: int = ATTEMPTS,
    seed: int = SEED,
    hasher: hashing.Hasher = hashing.mixed,
) -> DataFrame:
    """For each positive the first of ``attempts`` random items that its player never played.

    All attempts are drawn at once by hash and the played ones removed by an anti join; a positive
    whose attempts were all played has no negative.
    """
    numbered = hash_rank(items.select("game_title_id", "category_id"), ["game_title_id"], seed, hasher=hasher).select(
        (F.col("hash_rank") - 1).alias("_nth"),
        F.col("game_title_id").alias("negative_id"),
        F.col("category_id").alias("negative_category"),
    )
    size = items.agg(F.count(F.lit(1))).scalar()
    draw = hasher([F.col("player_id"), F.col("game_title_id"), F.col("attempt")], seed + 1) % size
    drawn = (
        pos.select("player_id", "game_title_id", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"))
        .withColumn("_nth", draw)
        .join(numbered, "_nth")
    )
    seen = of_spine(interactions, pos, ["player_id"]).select("player_id", F.col("game_title_id").alias("negative_id"))
    return (
        drawn.join(seen, ["player_id", "negative_id"], "left_anti")
        .groupBy("player_id", "game_title_id")
        .agg(
            F.min_by("negative_id", "attempt").alias("negative_id"),
            F.min_by("negative_category", "attempt").alias("negative_category"),
        )
    )


def spine(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Positive and negative rows with the reference time of the positive.

    ``positive_id`` names the pair's positive item, so (player_id, positive_id, label) is a key.
    """
    base = pos.select("player_id", "game_title_id", "category_id", F.col("last_play_ts").alias("ref_ts"))
    plus = base.select(
        "player_id", F.col("game_title_id").alias("positive_id"), "game_title_id", "category_id", "ref_ts",
        F.lit(1).alias("label"),
    )
    minus = base.drop("category_id").join(neg, ["player_id", "game_title_id"]).select(
        "player_id",
        F.col("game_title_id").alias("positive_id"),
        F.col("negative_id").alias("game_title_id"),
        F.col("negative_category").alias("category_id"),
        "ref_ts",
        F.lit(0).alias("label"),
    )
    return plus.unionByName(minus).withColumn("row_id", F.concat_ws("-", "player_id", "positive_id", "label"))


def recency_as_of(
    rows: DataFrame, events: DataFrame, event_ts: str, hours: int = 24, cap: int = RECENCY_CAP
) -> DataFrame:
    """Add the capped count of the player's events in the row's category before ``ref_ts``.

    The window is ``[ref_ts - hours, ref_ts)``: the label event itself never counts. Stage ``rows`` first, they are
    read several times. The events of their players are written once, as both running sums read them; of few rows
    the sums read only the categories each player is asked about.
    """
    keys = ["player_id", "category_id"]
    asked = of_spine(events, rows, ["player_id"]).filter(F.col("category_id").isNotNull())
    events = of_spine(stage(asked.select(*keys, event_ts), "asked-events"), rows, keys)
    counted = trailing(rows, events, keys, "ref_ts", event_ts, {"recent": hours}, {"plays": F.lit(1)})
    return counted.withColumn("recent_cat_activity_norm", recency_norm(F.col("plays_recent"), cap)).drop("plays_recent")


def static_features(
    rows: DataFrame,
    affinity: DataFrame,
    behavior: DataFrame,
    profile: DataFrame,
    columns: Mapping[int, str] = AFFINITY_COLUMNS,
) -> DataFrame:
    """The five features that do not depend on the row's time. Popularity is relative to the whole catalogue."""
    most = F.greatest(profile.agg(F.max("rounds_30d")).scalar(), F.lit(1))
    items = profile.select(
        "game_title_id",
        ratio(F.col("rounds_30d"), most).alias("game_rounds_30d_norm"),
        "popularity_trend",
        (F.coalesce("return_to_player_pct", F.lit(0)).cast("double") / F.lit(100.0)).alias("rtp_frac"),
    )
    affinity, behavior = (of_spine(side, rows, ["player_id"]) for side in (affinity, behavior))
    shares = affinity.select("player_id", affinity_map(columns).alias("_shares"))
    activity = behavior.select("player_id", F.col("rounds_30d").cast("double").alias("player_rounds_30d"))
    return (
        rows.join(items, "game_title_id")
        .join(shares, "player_id", "left")
        .join(activity, "player_id", "left")
        .withColumn(
            "aff_for_category",
            F.coalesce(affinity_of(F.col("_shares"), F.col("category_id"), columns), F.lit(0.0)),
        )
        .withColumn("player_rounds_30d", F.coalesce("player_rounds_30d", F.lit(0.0)))
        .drop("_shares")
    )


def ranker_dataset(
    interactions: DataFrame,
    items: DataFrame,
    rounds: DataFrame,
    affinity: DataFrame,
    behavior: DataFrame,
    profile: DataFrame,
    columns: Mapping[int, str] = AFFINITY_COLUMNS,
    n_pos: int | None = N_POSITIVES,
    attempts: int = ATTEMPTS,
    seed: int = SEED,
    hasher: hashing.Hasher = hashing.mixed,
    cap: int = RECENCY_CAP,
) -> DataFrame:
    """Positives and negatives with the six ranker features and ``label``; sample and spine are written once.

    Without ``n_pos`` every played pair is a positive.
    """
    pos = stage(positives(interactions, n_pos, seed, hasher), "positives")
    rows = stage(spine(pos, negatives(pos, interactions, items, attempts, seed, hasher)), "spine")
    events = rounds.join(items.select("game_title_id", "category_id"), "game_title_id")
    dated = recency_as_of(rows, events, "round_start_timestamp", cap=cap)
    return static_features(dated, affinity, behavior, profile, columns).select(
        "row_id", "player_id", "positive_id", "game_title_id", "category_id", "ref_ts", "label", *FEATURE_COLS
    )


def quantile_threshold(df: DataFrame, column: str, q: float) -> DataFrame:
    """The linearly interpolated quantile as one row, exact and without a sort in one task."""
    found = quantiles(df, column, [q]).select(F.col("quantiles")[0].alias("threshold"))
    return found.agg(F.max("threshold").alias("threshold"))


def propensity_dataset(
    affinity: DataFrame, behavior: DataFrame, columns: Mapping[int, str] = AFFINITY_COLUMNS, q: float = 0.65
) -> DataFrame:
    """One row per player with affinity and behaviour; the label is activity above the ``q`` quantile."""
    names = [*columns.values(), *PROPENSITY_EXTRA]
    joined = affinity.join(
        behavior.select("player_id", "rounds_7d", *PROPENSITY_EXTRA), "player_id"
    ).withColumns({c: fill_feature(F.col(c)) for c in names})
    threshold = quantile_threshold(joined.select("rounds_7d"), "rounds_7d", q).scalar()
    return joined.select("player_id", *names, (F.col("rounds_7d") > threshold).cast("int").alias("label"))


def _assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features")


def fit_ranker(train: DataFrame, monotone: bool = True, columns: Sequence[str] = tuple(FEATURE_COLS)) -> PipelineModel:
    """The ranker: P(label = 1) from the features in model order.

    Spark's boosted trees cannot be told that recency must never lower a score, so the default is a
    logistic regression whose recency coefficient is bounded below by 0, an exact guarantee.
    ``monotone=False`` trains boosted trees instead.
    """
    if monotone:
        lower = [0.0 if c == "recent_cat_activity_norm" else NO_BOUND for c in columns]
        learner = LogisticRegression(
            featuresCol="features",
            labelCol="label",
            maxIter=100,
            lowerBoundsOnCoefficients=Matrices.dense(1, len(columns), lower),
        )
    else:
        learner = GBTClassifier(featuresCol="features", labelCol="label", seed=SEED, **TREES)
    return Pipeline(stages=[_assembler(columns), learner]).fit(train)


def fit_boosted(
    train: DataFrame,
    columns: Sequence[str] = tuple(FEATURE_COLS),
    key: Sequence[str] = ("row_id",),
    rising: Sequence[str] = ("recent_cat_activity_norm",),
    settings: boosting.Settings = boosting.Settings(),  # noqa: B008 (frozen)
) -> boosting.BoostedTrees:
    """Boosted trees that never score lower for a higher value of the ``rising`` features; ``key`` names a row."""
    return boosting.fit(train, columns, key, monotone=dict.fromkeys(rising, 1), settings=settings)


def fit_propensity(train: DataFrame, columns: Mapping[int, str] = AFFINITY_COLUMNS, **overrides) -> PipelineModel:
    learner = GBTClassifier(featuresCol="features", labelCol="label", seed=SEED, **{**TREES, **overrides})
    return Pipeline(stages=[_assembler([*columns.values(), *PROPENSITY_EXTRA]), learner]).fit(train)


def evaluate(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Held-out metrics as one row: auc, rows, positive rate.

    Rows that could not be scored are left out; with a single class ``auc`` is NULL and
    ``skipped`` says so.
    """
    total = F.col("positives") + F.col("negatives")
    return auc(scored, label, score).select(
        F.round("auc", 4).alias("test_auc"),
        total.alias("test_rows"),
        F.round(F.col("positives") / F.nullif(total.cast("double"), F.lit(0.0)), 4).alias("test_positive_rate"),
        F.col("auc").isNull().alias("skipped"),
    )


def feature_importance(
    model: PipelineModel, train: DataFrame, columns: Sequence[str] = tuple(FEATURE_COLS)
) -> DataFrame:
    """Features by importance, largest first: tree gain, or |coefficient| x standard deviation."""
    learner = model.stages[-1]
    if hasattr(learner, "featureImportances"):
        weight = {c: F.lit(float(learner.featureImportances[i])) for i, c in enumerate(columns)}
        table = train.sparkSession.range(1).select(*[w.alias(c) for c, w in weight.items()])
    else:
        weight = {c: abs(float(learner.coefficients[i])) for i, c in enumerate(columns)}
        table = train.agg(*[(F.stddev(c) * F.lit(w)).alias(c) for c, w in weight.items()])
    return table.unpivot([], list(columns), "feature", "importance").orderBy(F.desc("importance"), "feature")


def version_path(root: str, name: str, version: str) -> str:
    return f"{root.rstrip('/')}/{name}/{version}"


def save_version(model: PipelineModel, root: str, name: str, version: str) -> str:
    """Store a model next to its older versions; an existing version is never replaced."""
    path = version_path(root, name, version)
    model.write().save(path)
    return path


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str], score: str = "score") -> DataFrame:
    """P(class = 1) next to the ``keep`` columns."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(score))

