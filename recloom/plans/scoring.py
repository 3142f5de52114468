"""Scoring candidates with a fitted model, in bulk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions.scalars import fill_feature
from recloom.operators.boosting import BoostedTrees
from recloom.schemas import FEATURE_COLS

Scorer = Callable[[DataFrame], DataFrame]


class RankerUnavailable(RuntimeError):
    """No fitted ranker at hand. There is no heuristic to fall back to."""


def fill_features(df: DataFrame, columns: list[str] = FEATURE_COLS) -> DataFrame:
    return df.withColumns({c: fill_feature(F.col(c)) for c in columns})


def load_ranker(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as exc:
        raise RankerUnavailable(f"no ranker at {path}") from exc


def model_scorer(model: PipelineModel | None) -> Scorer:
    """P(class = 1) of the fitted pipeline as column ``score``, its raw margin as ``rank_score``."""
    if model is None:
        raise RankerUnavailable("no ranker given")

    def score(df: DataFrame) -> DataFrame:
        names = df.columns
        scored = model.transform(fill_features(df))
        return scored.select(
            *names,
            vector_to_array("probability")[1].alias("score"),
            vector_to_array("rawPrediction")[1].alias("rank_score"),
        )

    return score


def boosted_scorer(model: BoostedTrees | None) -> Scorer:
    """The score and margin of boosted trees, as columns ``score`` and ``rank_score``."""
    if model is None:
        raise RankerUnavailable("no ranker given")
    return lambda df: model.transform(fill_features(df))


def expression_scorer(expression: str, margin: str | None = None) -> Scorer:
    """A fixed SQL expression over the filled features; for checks against other engines.

    ``margin`` is what the rails are ordered by, where the score is a squashed form of it.
    """

    def score(df: DataFrame) -> DataFrame:
        scored = fill_features(df).withColumn("score", F.expr(expression))
        return scored if margin is None else scored.withColumn("rank_score", F.expr(margin))

    return score


def item_part(model: PipelineModel) -> str | None:
    """What a logistic ranker adds per item, as SQL over the item features; None for other models."""
    learner = model.stages[-1]
    if not isinstance(learner, LogisticRegressionModel):
        return None
    weights = dict(zip(FEATURE_COLS, learner.coefficients, strict=True))
    per_item = ("game_rounds_30d_norm", "popularity_trend", "rtp_frac")
    return " + ".join(f"{name} * {float(weights[name])!r}D" for name in per_item)
