"""Models boosted together against pyspark.ml, one fit at a time."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from flickpulse.operators import boosting
from flickpulse.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(7)
    made = []
    for i in range(900):
        a, b, kind = r.random(), float(r.randrange(9)), r.choice(["x", "y", "z"])
        y = 3 * a + (b > 4) * (2 if kind == "x" else -1) + r.gauss(0, 0.3)
        made.append((i, a, b, 1.0, kind, y, float(y > 1.5)))
    return spark.createDataFrame(made, "title_id long, a double, b double, same double, kind string, y double, good double").persist()


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("counted", "counted")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    work()
    found = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(found)


def largest_gap(left, right, a, b):
    return left.join(right, "title_id").agg(F.max(F.abs(F.col(a) - F.col(b)))).first()[0]


def test_regression_as_in_pyspark_ml(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "ROWS_A_TASK", 300)  # several tasks and blocks
    monkeypatch.setattr(boosting, "ROWS_A_BLOCK", 100)
    monkeypatch.setattr(boosting, "CHECKPOINT", 4)
    features, stage = ["a", "b", "same"], GBTRegressor(labelCol="y", maxIter=12, maxDepth=3, stepSize=0.1, seed=3)
    weights = [M.poisson_weight("title_id", i) for i in range(2)] + [(F.col("title_id") % 5 != 0).cast("int")]
    got = boosting.boosted(rows, features, "y", weights, stage).select("title_id", "p0", "p1", "p2").persist()
    assert got.count() == 900
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    for i, w in enumerate(weights):
        model = stage.copy().setWeightCol("w").fit(vectors.withColumn("w", w.cast("double")).filter("w > 0"))
        assert largest_gap(model.transform(vectors), got, "prediction", f"p{i}") < 1e-9


def test_classes_and_names_as_in_pyspark_ml(spark, rows):
    stage = GBTClassifier(labelCol="good", maxIter=10, maxDepth=3, stepSize=0.1, seed=3)
    got = boosting.boosted(rows, ["a", "b"], "good", [F.lit(1)], stage, True, {"kind": ["x", "y", "z"]})
    wide = rows.select("*", *[(F.col("kind") == k).cast("double").alias("is_" + k) for k in "xyz"])
    vectors = VectorAssembler(inputCols=["a", "b", "is_x", "is_y", "is_z"], outputCol="features").transform(wide)
    said = stage.fit(vectors).transform(vectors).select("title_id", F.col("probability").alias("v"))
    from pyspark.ml.functions import vector_to_array
    said = said.select("title_id", vector_to_array("v")[1].alias("p"))
    assert largest_gap(said, got.withColumn("q", 1 / (1 + F.exp(-2 * F.col("p0")))), "p", "q") < 1e-9


def test_jobs_do_not_grow_with_the_models(spark, rows, monkeypatch):
    few = GBTRegressor(labelCol=M.LABEL, maxIter=4, maxDepth=3, stepSize=0.1, seed=3)
    monkeypatch.setattr(M, "regressor", lambda *a: few.copy())
    frame = rows.withColumnRenamed("y", M.LABEL)
    at = {n: jobs_of(spark, lambda n=n: M.oof_predict(frame, ["a", "b"], "gbt", n).count()) for n in (2, 6)}
    assert at[6] - at[2] <= 2 * 4 < 4 * 3 * 4  # a scaler a fold; before: four more models of four rounds of three levels
    said = M.oof_predict(frame, ["a", "b"], "gbt", 3)
    assert said.columns == [*frame.columns, "fold", "prediction"] and said.count() == 900


def test_band_fits_its_resamples_together(spark, rows, monkeypatch):
    few = GBTRegressor(labelCol=M.LABEL, maxIter=3, maxDepth=3, stepSize=0.1, seed=3)
    monkeypatch.setattr(M, "regressor", lambda *a: few.copy())
    frame = rows.withColumnRenamed("y", M.LABEL)
    known = rows.select("title_id", F.lit(0.5).alias("p_disclosed"))
    got = []
    n = jobs_of(spark, lambda: got.extend(M.confidence_band(frame, known, ["a", "b"], replicates=8).collect()))
    assert n < (8 + 5) * 3 * 3  # before: each of 8 resamples and 5 folds had at least three jobs a round
    assert len(got) == 900 and all(r["half"] >= 0 and r["low"] <= r["prediction"] <= r["high"] for r in got)


def test_boost_as_its_pipeline(spark, rows):
    """Midpoints that hit a value exactly fall as in the standardised features of ``pipeline``."""
    stage = GBTRegressor(labelCol=M.LABEL, maxIter=8, maxDepth=3, stepSize=0.1, seed=3)
    frame = rows.withColumnRenamed("y", M.LABEL).withColumn("tenth", F.floor(F.col("a") * 20) / 10).repartition(1).persist()
    features, weights = ["tenth", "b", "same"], [(F.col("title_id") % 3 != k).cast("double") for k in range(3)]
    got = M.boost(frame, features, weights, stage)
    for k, w in enumerate(weights):
        model = M.pipeline(features, stage.copy(), "w").fit(frame.withColumn("w", w).filter("w > 0"))
        assert largest_gap(model.transform(frame).select("title_id", "prediction"), got, "prediction", f"p{k}") < 1e-9


def test_null_features_and_empty_folds_are_refused(spark, rows):
    stage = GBTRegressor(labelCol="y", maxIter=2, maxDepth=2)
    with pytest.raises(Exception, match="null"):
        boosting.boosted(rows.withColumn("a", F.when(F.col("title_id") != 3, F.col("a"))), ["a"], "y", [F.lit(1)], stage)
    with pytest.raises(ValueError, match="no rows"):
        boosting.boosted(rows, ["a"], "y", [F.lit(1), F.lit(0)], stage)


def test_limits_halve_the_way_between_values():
    import numpy as np
    assert boosting.bin_limits(np.array([1.0, 2, 2, 5, 9]), np.array([1.0, 1, 1, 1, 0]), 32).tolist() == [1.5, 3.5]
    even = boosting.bin_limits(np.arange(100.0), np.ones(100), 4)
    assert even.tolist() == [24.5, 49.5, 74.5]
