"""Training sets, models and metrics. Samples use the portable hash, so SQL draws the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions import hashing
from recloom.operators import ranking
from recloom.plans import features, point_in_time, recommend, scoring, training
from recloom.queries.candidates import CANDIDATES, context, last_played, recent_rows
from recloom.queries.features import rollup
from recloom.queries.registry import query, shareable
from recloom.schemas import FEATURE_COLS
from recloom.session import scratch_path
from recloom.sources.staging import stage
from recloom.sources.star import AFFINITY, ROUNDS_AS_OF, Star

PAIR_HASH = hashing.portable_sql(["player_id", "game_title_id"], training.SEED)
SAMPLE = 6_000

TRAINING = f"""
WITH pos AS (
  SELECT player_id, game_title_id, category_id, last_play_ts AS ref_ts FROM interactions
  ORDER BY {PAIR_HASH}, player_id, game_title_id LIMIT {training.N_POSITIVES}
), numbered AS (
  SELECT game_title_id AS negative_id, category_id AS negative_category,
         row_number() OVER (ORDER BY {hashing.portable_sql(["game_title_id"], training.SEED)}, game_title_id) - 1 AS nth
  FROM items
), drawn AS (
  SELECT p.player_id, p.game_title_id, CAST(t.attempt AS BIGINT) AS attempt, n.negative_id, n.negative_category
  FROM pos p, range(1, 6) t(attempt) JOIN numbered n
    ON n.nth = {hashing.portable_sql(["p.player_id", "p.game_title_id", "t.attempt"], training.SEED + 1)} % (SELECT count(*) FROM items)
), neg AS (
  SELECT player_id, game_title_id, negative_id, negative_category FROM (
    SELECT d.*, row_number() OVER (PARTITION BY d.player_id, d.game_title_id ORDER BY attempt) AS rn FROM drawn d
    WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.player_id = d.player_id AND i.game_title_id = d.negative_id))
  WHERE rn = 1
), spine AS (
  SELECT player_id, game_title_id AS positive_id, game_title_id, category_id, ref_ts, 1 AS label FROM pos
  UNION ALL
  SELECT p.player_id, p.game_title_id, n.negative_id, n.negative_category, p.ref_ts, 0 FROM pos p JOIN neg n USING (player_id, game_title_id)
)
"""

DATASET = TRAINING + """, recency AS (
  SELECT s.player_id, s.positive_id, s.label, count(f.category_id) AS plays
  FROM spine s LEFT JOIN (SELECT r.player_id, r.ts, i.category_id FROM rounds r JOIN items i USING (game_title_id)) f
    ON f.player_id = s.player_id AND f.category_id = s.category_id
   AND f.ts >= s.ref_ts - INTERVAL 24 HOUR AND f.ts < s.ref_ts
  GROUP BY s.player_id, s.positive_id, s.label
), dataset AS (
  SELECT s.player_id, s.positive_id, s.game_title_id, s.label,
         coalesce(CASE s.category_id WHEN 1 THEN a.aff_economy WHEN 2 THEN a.aff_large WHEN 3 THEN a.aff_medium
           WHEN 4 THEN a.aff_promo WHEN 5 THEN a.aff_small ELSE a.aff_standard END, 0) AS aff_for_category,
         CAST(p.rounds_30d AS DOUBLE) / (SELECT greatest(max(rounds_30d), 1) FROM item_profile) AS game_rounds_30d_norm,
         p.popularity_trend, CAST(p.return_to_player_pct AS DOUBLE) / 100 AS rtp_frac,
         CAST(coalesce(b.rounds_30d, 0) AS DOUBLE) AS player_rounds_30d,
         least(r.plays, 10) / 10.0::DOUBLE AS recent_cat_activity_norm
  FROM spine s JOIN item_profile p ON p.game_title_id = s.game_title_id LEFT JOIN affinity a ON a.player_id = s.player_id
  LEFT JOIN behavior b ON b.player_id = s.player_id
  JOIN recency r ON r.player_id = s.player_id AND r.positive_id = s.positive_id AND r.label = s.label
)
"""


LEAK_FREE = TRAINING + """, known AS (
  SELECT r.player_id, r.game_title_id, i.category_id, r.ts, r.round_date FROM rounds r JOIN items i USING (game_title_id)
), moments AS (
  SELECT DISTINCT player_id, ref_ts FROM spine
), weights AS (
  SELECT m.player_id, m.ref_ts, k.category_id,
         sum(greatest(900, (180 - date_diff('day', k.round_date, m.ref_ts::DATE)) * 100)) AS w,
         count(*) FILTER (k.ts >= m.ref_ts - INTERVAL 24 HOUR) AS plays
  FROM moments m JOIN known k ON k.player_id = m.player_id AND k.ts < m.ref_ts GROUP BY ALL
), totals AS (
  SELECT player_id, ref_ts, sum(w) AS w FROM weights GROUP BY ALL
), active AS (
  SELECT m.player_id, m.ref_ts, count(*) AS n FROM moments m JOIN rounds r
    ON r.player_id = m.player_id AND r.ts < m.ref_ts AND r.ts >= m.ref_ts - INTERVAL 30 DAY GROUP BY ALL
), per_day AS (
  SELECT game_title_id, round_date, count(*) AS n FROM known GROUP BY ALL
), popular AS (
  SELECT d.day, p.game_title_id, sum(CASE WHEN p.round_date >= d.day - 30 THEN n ELSE 0 END) AS now,
         sum(CASE WHEN p.round_date < d.day - 30 THEN n ELSE 0 END) AS ago
  FROM (SELECT DISTINCT ref_ts::DATE AS day FROM spine) d JOIN per_day p ON p.round_date < d.day AND p.round_date >= d.day - 60
  GROUP BY ALL
), tops AS (
  SELECT day, max(now) AS most FROM popular GROUP BY day
)
SELECT s.player_id, s.positive_id, s.game_title_id, s.label, coalesce(CAST(w.w AS DOUBLE) / CAST(t.w AS DOUBLE), 0) AS aff_for_category,
       CAST(coalesce(p.now, 0) AS DOUBLE) / greatest(coalesce(o.most, 0), 1) AS game_rounds_30d_norm,
       CAST(coalesce(p.now, 0) AS DOUBLE) / (coalesce(p.ago, 0) + 1) AS popularity_trend,
       CAST(i.return_to_player_pct AS DOUBLE) / 100 AS rtp_frac, CAST(coalesce(a.n, 0) AS DOUBLE) AS player_rounds_30d,
       least(coalesce(w.plays, 0), 10) / 10.0::DOUBLE AS recent_cat_activity_norm
FROM spine s JOIN items i ON i.game_title_id = s.game_title_id
LEFT JOIN weights w ON w.player_id = s.player_id AND w.ref_ts = s.ref_ts AND w.category_id = s.category_id
LEFT JOIN totals t ON t.player_id = s.player_id AND t.ref_ts = s.ref_ts
LEFT JOIN active a ON a.player_id = s.player_id AND a.ref_ts = s.ref_ts
LEFT JOIN popular p ON p.day = s.ref_ts::DATE AND p.game_title_id = s.game_title_id
LEFT JOIN tops o ON o.day = s.ref_ts::DATE
"""


def played(star: Star) -> DataFrame:
    return features.interactions(rollup(star), star.items)


@query(
    "tr1_positive_sample",
    f"""SELECT player_id, game_title_id, category_id, last_play_ts FROM interactions
        ORDER BY {PAIR_HASH}, player_id, game_title_id LIMIT {SAMPLE}""",
)
def tr1(star: Star) -> DataFrame:
    return training.positives(played(star), SAMPLE, hasher=hashing.portable).select(
        "player_id", "game_title_id", "category_id", "last_play_ts"
    )


@shareable
def pairs(star: Star) -> tuple[DataFrame, DataFrame]:
    known = stage(played(star), "interactions")
    pos = stage(training.positives(known, hasher=hashing.portable), "positives")
    return pos, training.negatives(pos, known, star.items, hasher=hashing.portable)


@query("tr2_negative_sampling", TRAINING + "SELECT player_id, game_title_id, negative_id, negative_category FROM neg")
def tr2(star: Star) -> DataFrame:
    return pairs(star)[1]


@query(
    "tr3_training_spine",
    TRAINING + "SELECT player_id, positive_id, game_title_id, category_id, ref_ts, label FROM spine",
)
def tr3(star: Star) -> DataFrame:
    return training.spine(*pairs(star)).drop("row_id")


@query("so4_stacked_labels", TRAINING + "SELECT label, category_id, count(*) AS rows FROM spine GROUP BY ALL")
def so4(star: Star) -> DataFrame:
    return training.spine(*pairs(star)).groupBy("label", "category_id").agg(F.count(F.lit(1)).alias("rows"))


@shareable
def dataset(star: Star, n_pos: int | None = training.N_POSITIVES) -> DataFrame:
    """The feature tables come from one staged roll-up; the interactions feed both classes."""
    rolled = stage(rollup(star), "rollup")
    known = features.interactions(rolled, star.items)
    return training.ranker_dataset(
        known,
        star.items,
        star.rounds,
        features.player_affinity(rolled, star.items, star.categories, AFFINITY),
        features.player_behavior(rolled, star.players, star.regions, star.items, star.categories, ROUNDS_AS_OF),
        features.item_profile(rolled, star.items, star.categories),
        AFFINITY,
        n_pos,
        hasher=hashing.portable,
    )


@query(
    "tr4_point_in_time_recency",
    DATASET + "SELECT player_id, positive_id, label, recent_cat_activity_norm FROM dataset",
)
def tr4(star: Star) -> DataFrame:
    rows = stage(training.spine(*pairs(star)), "spine")
    events = star.rounds.join(star.items.select("game_title_id", "category_id"), "game_title_id")
    return training.recency_as_of(rows, events, "round_start_timestamp").select(
        "player_id", "positive_id", "label", "recent_cat_activity_norm"
    )


@query("tr5_ranker_dataset", DATASET + "SELECT * FROM dataset")
def tr5(star: Star) -> DataFrame:
    return dataset(star).drop("row_id", "category_id", "ref_ts")


@query("tr5_leak_free_dataset", LEAK_FREE)
def tr5_leak_free(star: Star) -> DataFrame:
    """Affinity, popularity and activity of each row as they stood before its time."""
    known = stage(played(star), "interactions")
    rows = point_in_time.leak_free_dataset(known, star.items, star.rounds, AFFINITY, hasher=hashing.portable)
    return rows.drop("row_id", "category_id", "ref_ts")


@query(
    "tr6_feature_vector",
    DATASET
    + """SELECT player_id, positive_id, label, aff_for_category AS x0, game_rounds_30d_norm AS x1, popularity_trend AS x2,
         rtp_frac AS x3, player_rounds_30d AS x4, recent_cat_activity_norm AS x5 FROM dataset""",
)
def tr6(star: Star) -> DataFrame:
    """The features as one vector in model order, read back by position."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=FEATURE_COLS, outputCol="features").transform(dataset(star))
    position = vector_to_array("features")
    return vectors.select(
        "player_id", "positive_id", "label", *[position[i].alias(f"x{i}") for i in range(len(FEATURE_COLS))]
    )


SPLIT_HASH = hashing.portable_sql(["player_id", "positive_id", "label"], training.SEED)
SPLIT = DATASET + f""", split AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {SPLIT_HASH}, player_id, positive_id)
    <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS is_test FROM dataset
)
"""


def split(star: Star, *n_pos: int | None) -> DataFrame:
    return ranking.stratified_split(
        dataset(star, *n_pos), "label", ["player_id", "positive_id", "label"], seed=training.SEED, hasher=hashing.portable
    )


@query("tr7_stratified_split", SPLIT + "SELECT player_id, positive_id, label, is_test FROM split")
def tr7(star: Star) -> DataFrame:
    return split(star).select("player_id", "positive_id", "label", "is_test")


@shareable
def trained(star: Star, *n_pos: int | None):
    """The default ranker on the training part, and the held-out part; of all played pairs if ``n_pos`` is None."""
    rows = stage(split(star, *n_pos), "split")
    return training.fit_ranker(rows.filter("NOT is_test")), rows


@query("tr8_monotone_ranker")
def tr8(star: Star) -> DataFrame:
    """Coefficients of the fitted ranker; recency's is never negative."""
    model, rows = trained(star)
    learner = model.stages[-1]
    table = rows.sparkSession.createDataFrame(
        [(c, float(learner.coefficients[i])) for i, c in enumerate(FEATURE_COLS)], "feature STRING, coefficient DOUBLE"
    )
    return table.withColumn("intercept", F.lit(float(learner.intercept)))


@query("tr8_boosted_ranker")
def tr8_boosted(star: Star) -> DataFrame:
    """Monotone boosted trees next to the logistic ranker: held-out AUC, importances, and for how many held-out rows
    the score falls as recency rises from none to all (none may). Both learn from all played pairs, not a sample."""
    logistic, rows = trained(star, None)
    model = training.fit_boosted(rows.filter("NOT is_test"))
    held_out = rows.filter("is_test")
    out = None
    for name, scored in (
        ("boosted", model.transform(held_out)),
        ("logistic", training.predict(logistic, held_out, ["label"])),
    ):
        told = training.evaluate(scored).select(
            F.lit(name).alias("model"), F.lit("test_auc").alias("measure"), F.col("test_auc").alias("value")
        )
        out = told if out is None else out.unionByName(told)
    recency = "recent_cat_activity_norm"
    low, high = (model.transform(held_out.withColumn(recency, F.lit(x))) for x in (0.0, 1.0))
    both = low.select("row_id", F.col("rank_score").alias("low")).join(high.select("row_id", F.col("rank_score").alias("high")), "row_id")
    falls = both.agg(F.count_if(F.col("high") < F.col("low")).cast("double").alias("value"))
    out = out.unionByName(falls.select(F.lit("boosted").alias("model"), F.lit("rows_that_fall").alias("measure"), "value"))
    shares = [("boosted", f"importance_{c}", v) for c, v in model.importance().items()]
    return out.unionByName(rows.sparkSession.createDataFrame(shares, "model STRING, measure STRING, value DOUBLE"))


@query(
    "tr9_propensity_dataset",
    """SELECT player_id, aff_economy, aff_large, aff_medium, aff_promo, aff_small, aff_standard,
         CAST(rounds_30d AS DOUBLE) AS rounds_30d, avg_stake_eur, coalesce(CAST(days_since_last_play AS DOUBLE), 0) AS days_since_last_play,
         CASE WHEN rounds_7d > (SELECT quantile_cont(rounds_7d, 0.65) FROM behavior JOIN affinity USING (player_id)) THEN 1 ELSE 0 END AS label
       FROM affinity JOIN behavior USING (player_id)""",
)
def tr9(star: Star) -> DataFrame:
    rolled = stage(rollup(star), "rollup")
    return training.propensity_dataset(
        features.player_affinity(rolled, star.items, star.categories, AFFINITY),
        features.player_behavior(rolled, star.players, star.regions, star.items, star.categories, ROUNDS_AS_OF),
        AFFINITY,
    )


@query(
    "tr10_roc_auc",
    DATASET
    + """, ranks AS (
      SELECT label, row_number() OVER (ORDER BY aff_for_category) AS rn, count(*) OVER (PARTITION BY aff_for_category) AS ties,
             min(rn) OVER (PARTITION BY aff_for_category) AS first_rank
      FROM (SELECT *, row_number() OVER (ORDER BY aff_for_category) AS rn FROM dataset)
    ), sums AS (
      SELECT sum(CASE WHEN label = 1 THEN CAST(2 * first_rank + ties - 1 AS HUGEINT) END) AS twice_ranks,
             count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM ranks
    ) SELECT CAST(twice_ranks - CAST(positives AS HUGEINT) * (positives + 1) AS DOUBLE)
               / (2.0::DOUBLE * CAST(positives AS DOUBLE) * CAST(negatives AS DOUBLE)) AS auc, positives, negatives FROM sums""",
)
def tr10(star: Star) -> DataFrame:
    """AUC of the affinity share alone, as a score."""
    return ranking.auc(dataset(star), "label", "aff_for_category")


@query("tr11_heldout_metrics")
def tr11(star: Star) -> DataFrame:
    model, rows = trained(star)
    scored = training.predict(model, rows.filter("is_test"), ["label"])
    return training.evaluate(scored)


@query("tr12_feature_importance")
def tr12(star: Star) -> DataFrame:
    model, rows = trained(star)
    return training.feature_importance(model, rows.filter("NOT is_test"))


@query("tr13_model_versions")
def tr13(star: Star) -> DataFrame:
    """Two versions side by side; both load and score the held-out rows."""
    model, rows = trained(star)
    root = scratch_path(star.spark, "models")
    held_out = rows.filter("is_test")
    out = None
    for version, columns in (("V1", FEATURE_COLS[:-1]), ("V2", FEATURE_COLS)):
        fitted = model if version == "V2" else training.fit_ranker(rows.filter("NOT is_test"), columns=columns)
        loaded = scoring.load_ranker(training.save_version(fitted, root, "ranker", version))
        metrics = training.evaluate(training.predict(loaded, held_out, ["label"])).withColumn("version", F.lit(version))
        out = metrics if out is None else out.unionByName(metrics)
    return out


@query("ud3_model_score")
def ud3(star: Star) -> DataFrame:
    model, rows = trained(star)
    return training.predict(model, rows, ["player_id", "positive_id", "label"])


@query(
    "tr14_batch_scoring",
    CANDIDATES + "SELECT request_id, count(*) AS candidates, bool_or(boosted) AS any_boosted, TRUE AS all_scored FROM scored GROUP BY request_id",
)
def tr14(star: Star) -> DataFrame:
    """Score every candidate with the fitted ranker; the comparison covers all but the scores."""
    model, _ = trained(star)
    done = recommend.recommend(
        last_played(star), context(star), scoring.model_scorer(model), ROUNDS_AS_OF, "V2", recent_rows(star)
    )
    return done.scored.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.bool_or("boosted").alias("any_boosted"),
        F.bool_and(F.col("score").between(0.0, 1.0)).alias("all_scored"),
    )


@query(
    "ud2_transform_hook",
    "SELECT category_id, count(*) AS plays FROM plays WHERE event_type = 'PLAY' GROUP BY category_id",
)
def ud2(star: Star) -> DataFrame:
    """A pass-through stage over whole Arrow batches, as an extension point."""

    def unchanged(batches):
        yield from batches

    gated = star.events.filter("event_type = 'PLAY'").select("player_id", "category_id")
    return gated.mapInArrow(unchanged, gated.schema).groupBy("category_id").agg(F.count(F.lit(1)).alias("plays"))

