"""The boosted ranker learns from every played pair, and what its training writes does not pile up."""

import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from recloom.operators import boosting
from recloom.plans import training
from recloom.queries import learning
from recloom.sources.star import SOURCE_SCHEMAS, Star

PAIRS, PLAYERS = training.N_POSITIVES + 5_000, 1_300


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Every player has played 50 of 400 items."""
    path = str(tmp_path_factory.mktemp("star"))
    at = F.lit(datetime(2001, 10, 1)).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 30).cast("int"))
    frames = {
        "region": spark.sql("SELECT 0 AS r_regionkey, 'EUROPE' AS r_name"),
        "nation": spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey"),
        "customer": spark.range(PLAYERS).selectExpr(
            "id AS c_custkey", "concat('c', id) AS c_name", "0 AS c_nationkey", "1.0D AS c_acctbal", "'S' AS c_mktsegment"
        ),
        "part": spark.range(400).selectExpr(
            "id AS p_partkey", "concat('p', id) AS p_name", "'b' AS p_brand",
            "element_at(array('ECONOMY', 'LARGE', 'SMALL'), cast(id % 3 + 1 AS int)) AS p_type",
            "cast(id % 49 + 1 AS int) AS p_size", "1.0D AS p_retailprice",
        ),
        "orders": spark.range(PAIRS).selectExpr(
            "id AS o_orderkey", f"id % {PLAYERS} AS o_custkey", "'F' AS o_orderstatus", "1.0D AS o_totalprice",
            "timestamp_ntz'2001-10-01 00:00:00' AS o_orderdate", "'1' AS o_orderpriority",
        ),
        "lineitem": spark.range(PAIRS).selectExpr(
            "id AS l_orderkey", f"(id div {PLAYERS}) * 7 % 400 AS l_partkey", "0L AS l_suppkey", "1 AS l_linenumber",
            "1.0D AS l_quantity", "10.0D AS l_extendedprice", "0.1D AS l_discount", "0.0D AS l_tax",
            "'N' AS l_returnflag", "'O' AS l_linestatus", "id",
        ).withColumn("l_shipdate", at).drop("id"),
    }
    for name, frame in frames.items():
        assert [f.name for f in frame.schema] == [c.split()[0] for c in SOURCE_SCHEMAS[name].split(", ")]
        frame.write.parquet(f"{path}/{name}.parquet")
    return Star(spark, path)


def test_boosted_ranker_learns_from_all_played_pairs(star, monkeypatch):
    class Enough(Exception):
        pass

    told = []

    def fit(train):
        told.append({r.label: r["count"] for r in train.groupBy("label").count().collect()})
        raise Enough

    monkeypatch.setattr(training, "fit_boosted", fit)
    monkeypatch.setattr(training, "fit_ranker", lambda train: None)
    with pytest.raises(Enough):
        learning.tr8_boosted(star)
    # a fifth of each class is held out; five attempts find a negative for nearly every pair
    assert told[0][1] == PAIRS - PAIRS // 5 and told[0][0] > 0.99 * told[0][1]
    known = learning.played(star)
    assert known.count() == PAIRS and training.positives(known).count() == training.N_POSITIVES


def test_margins_of_earlier_trees_are_removed(spark, monkeypatch):
    kept, stage = [], boosting.stage
    monkeypatch.setattr(boosting, "stage", lambda df, name: kept.append(stage(df, name)) or kept[-1])
    rng = np.random.default_rng(3)
    rows = [(str(k), float(rng.integers(0, 9)), int(rng.integers(0, 2))) for k in range(400)]
    frame = spark.createDataFrame(rows, "row_id string, x double, label int")
    settings = boosting.Settings(trees=3 * boosting.PENDING + 1, depth=2)
    model = boosting.fit(frame, ["x"], ["row_id"], settings=settings)
    assert len(model.trees) == settings.trees and len(kept) == 5
    folders = [os.path.dirname(df.inputFiles()[0]).removeprefix("file://") for df in kept]
    assert [os.path.exists(f) for f in folders] == [True, False, False, False, True]
