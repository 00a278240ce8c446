"""Sigmoids against a plain Newton fit; held-out margins come from models of other folds."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sparktab.operators import calibration, estimators
from sparktab.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def newton(f, y):
    """Damped Newton steps on the smoothed log loss."""
    ones, zeros = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    w = np.array([0.0, math.log((zeros + 1) / (ones + 1))])
    x = np.stack([f, np.ones_like(f)], axis=1)
    loss = lambda w: (t * (x @ w) + np.logaddexp(0, -(x @ w))).sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(np.clip(x @ w, -700, 700)))
        g = x.T @ (t - p)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-12 * np.eye(2), g)
        length = 1.0
        while loss(w - length * step) > loss(w) and length > 1e-6:
            length /= 2
        w = w - length * step
        if np.abs(g).max() < 1e-9:
            break
    return w


@pytest.mark.parametrize("kind", ["noisy", "separable", "one_sided"])
def test_sigmoid_equals_a_plain_fit(spark, kind):
    rng = np.random.default_rng(1)
    f = rng.standard_normal(500) * 2
    y = {"noisy": rng.random(500) < 1 / (1 + np.exp(-1.5 * f - 0.4)), "separable": f > 0, "one_sided": f > 99}[kind].astype(float)
    a, b = calibration.fit_sigmoid(spark.createDataFrame([(float(m), float(t)) for m, t in zip(f, y)], "margin double, label double"))
    assert np.allclose([a, b], newton(f, y), rtol=1e-4, atol=1e-4)
    if kind == "noisy":
        assert a < 0


def test_margins_are_of_models_that_did_not_see_the_row(spark):
    df = spark.range(300).select("id", (F.col("id") % 3 == 0).cast("double").alias("label"))
    seen = []

    def fit(train):
        ids = {r.id for r in train.select("id").collect()}
        seen.append(ids)
        return lambda rows: rows.withColumn("margin", F.col("id").cast("double"))

    out = calibration.held_out_margins(df, fit, "id", 7)
    assert sorted(int(r.margin) for r in out.collect()) == list(range(300))
    folds = {r.id: r.fold for r in df.select("id", calibration.fold_of("id", 7).alias("fold")).collect()}
    assert len(seen) == calibration.FOLDS
    for k in set(folds.values()):
        assert {i for i, fold in folds.items() if fold != k} in seen
    alone = df.limit(1).union(df.where("label = 0").limit(3))
    assert calibration.held_out_margins(alone, fit, "id", 7).count() == 4


def test_svm_probabilities_follow_the_margin(spark, tmp_path):
    cells = [F.col(c).cast("double") / 10 for c in ("l_quantity", "l_discount", "l_tax")]
    rows = fx.clf_base(spark, SF).select(array_to_vector(F.array(*cells)).alias("features"), (F.col("l_quantity") + F.pmod(F.xxhash64("row_id"), F.lit(20)) > 35).cast("double").alias("label"), "row_id").persist()
    stages = estimators.fit_classifier("svm", rows, 2, {"kernel": "linear"}, "row_id")
    model = PipelineModel(stages)
    model.write().save(str(tmp_path / "m"))
    out = PipelineModel.load(str(tmp_path / "m")).transform(rows)
    a, b = stages[-1].value("slope"), stages[-1].value("offset")
    got = out.select(vector_to_array("margins")[1].alias("m"), vector_to_array("probability")[1].alias("p"), "label", "prediction").collect()
    assert a < 0
    assert np.allclose([r.p for r in got], [1 / (1 + math.exp(a * r.m + b)) for r in got])
    assert all((r.m > 0) == (r.prediction == 1) for r in got if abs(r.m) > 1e-12)
    bins = {}
    for r in got:
        bins.setdefault(min(9, int(r.p * 10)), []).append((r.p, r.label))
    assert sum(abs(sum(p - y for p, y in v)) for v in bins.values()) / len(got) < 0.05
