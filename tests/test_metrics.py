import math

import pytest
from pyspark.sql import functions as F

from sparktab.operators import metrics


def scored(spark, rows, kind="int"):
    return spark.createDataFrame(rows, f"label {kind}, prediction {kind}, probability array<double>")


def test_labels_other_than_zero_one(spark):
    df = scored(spark, [("a", "a", [0.9, 0.1]), ("b", "a", [0.6, 0.4]), ("b", "b", [0.2, 0.8])], "string")
    row = metrics.metric_payload(df, ["a", "b"]).first()
    assert row["precision"] == 1.0 and row["recall"] == 0.5
    assert row["confusion_matrix"] == [[1, 0], [1, 1]]
    assert row["roc_auc"] == 1.0
    assert row["brier_score"] == pytest.approx((0.01 + 0.36 + 0.04) / 3)


def test_prediction_outside_the_true_labels(spark):
    df = scored(spark, [(0, 2, [0.2, 0.1, 0.7]), (1, 1, [0.1, 0.8, 0.1])])
    row = metrics.metric_payload(df, [0, 1, 2]).first()
    assert row["confusion_matrix"] == [[0, 0, 1], [0, 1, 0], [0, 0, 0]]
    for name in ("mae", "mse", "rmse", "log_loss", "brier_score", "roc_auc"):
        assert row[name] is None
    assert row["recall"] == 1.0


def test_nothing_predicted_positive(spark):
    df = scored(spark, [(0, 0, [0.9, 0.1]), (1, 0, [0.8, 0.2])])
    row = metrics.classification_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_three_labels_use_plain_means(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 1)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    row = metrics.classification_metrics(df).first()
    assert row["precision"] == pytest.approx((1 + 1 / 3 + 0) / 3)
    assert row["recall"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert row["f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_certain_wrong_probability_is_clipped(spark):
    df = scored(spark, [(0, 1, [0.0, 1.0]), (1, 1, [0.0, 1.0])])
    loss = metrics.probability_losses(df, [0, 1]).first()["log_loss"]
    assert loss == pytest.approx(-math.log(2.0**-52) / 2, rel=1e-6)


def auc(df, positive=1, flip=False):
    score = 1 - F.col("s") if flip else F.col("s")
    return metrics.auc_by_group(df, F.lit(1), score, F.col("label") == positive).first()["auc"]


@pytest.fixture(scope="module")
def ranked(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(97)) / 97
    return spark.range(3000).select(
        (F.col("id") % 3 == 0).cast("int").alias("label"),
        F.when(F.col("id") < 1000, 0.5).otherwise(noise + (F.col("id") % 3 == 0).cast("int") * 0.2).alias("s"),
    )


def test_auc_mirrors_and_buckets_agree(ranked, monkeypatch):
    plain, curve = auc(ranked), metrics.curve_points(ranked, F.col("s"), F.col("label") == 1)
    assert auc(ranked, flip=True) == pytest.approx(1 - plain)
    single = sorted(map(tuple, curve.select("threshold", "tp", "fp", "pos_total").collect()))
    monkeypatch.setattr(metrics, "SCORES_PER_BUCKET", 20)
    assert auc(ranked) == pytest.approx(plain, rel=1e-12)
    cut = metrics.curve_points(ranked, F.col("s"), F.col("label") == 1)
    assert sorted(map(tuple, cut.select("threshold", "tp", "fp", "pos_total").collect())) == single


def test_null_scores_rank_below_and_nan_above(spark, monkeypatch):
    rows = [(0, None), (1, -0.5), (0, -0.25), (1, 0.5), (1, 0.75), (0, float("nan"))]
    df = spark.createDataFrame(rows, "label int, s double")
    monkeypatch.setattr(metrics, "SCORES_PER_BUCKET", 2)
    points = metrics.curve_points(df, F.col("s"), F.col("label") == 1).orderBy(F.desc("threshold")).collect()
    assert [(r["tp"], r["fp"]) for r in points] == [(0, 1), (1, 1), (2, 1), (2, 2), (3, 2), (3, 3)]


def test_one_class_has_no_auc(spark):
    df = scored(spark, [(0, 0, [0.9, 0.1])])
    assert metrics.roc_auc(df, [0, 1]).first()["roc_auc"] is None
