"""The dual solution by its certificate: the gap between primal and dual objective."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparktab.operators import kernel_svm

GAMMA = 0.7


def noisy_rings(spark, n):
    r = 1 + F.col("id") % 2 * 2 + (F.pmod(F.xxhash64("id"), F.lit(1000)) / 400)
    x = F.array(F.cos("id") * r, F.sin("id") * r)
    return spark.range(0, n, 1, 4).select(array_to_vector(x).alias("features"), (F.col("id") % 2).cast("double").alias("label"), "id")


def gap(model, x, y, c):
    """(dual, primal) objective of a model; they are equal at the optimum only."""
    k = kernel_svm.kernel(model.vectors, model.vectors, GAMMA)
    norm = model.weights @ k @ model.weights
    f = kernel_svm.expansion(x, model.vectors, model.weights, GAMMA) + model.value("offset")
    return np.abs(model.weights).sum() - norm / 2, norm / 2 + c * np.maximum(0, 1 - y * f).sum()


@pytest.mark.parametrize("c,working", [(1.0, 64), (1.0, 1024), (10.0, 200)])
def test_dual_objective_is_optimal(spark, c, working):
    df = noisy_rings(spark, 2000)
    rows = df.collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([2 * r.label - 1 for r in rows])
    model = kernel_svm.fit_kernel_svm(df, 2, c, GAMMA, working=working)
    dual, primal = gap(model, x, y, c)
    assert 0 <= primal - dual < 2e-3 * primal
    assert abs(model.weights.sum()) < 1e-6 and np.abs(model.weights).max() <= c + 1e-12
    assert model.value("rounds") >= (3 if working == 64 else 1)


def test_separates_rings_and_survives_saving(spark, tmp_path):
    df = noisy_rings(spark, 600)
    model = kernel_svm.fit_kernel_svm(df, 2, 1.0, GAMMA)
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    before, after = (m.transform(df).orderBy("id").collect() for m in (model, loaded))
    assert [r.prediction for r in before] == [r.prediction for r in after]
    assert np.allclose([r.margins[1] for r in before], [r.margins[1] for r in after])
    assert sum(r.prediction == r.label for r in before) > 540


def test_equal_rows_of_both_classes_and_one_class(spark):
    same = spark.range(40).select(array_to_vector(F.array(F.lit(1.0), F.lit(2.0))).alias("features"), (F.col("id") % 4 == 0).cast("double").alias("label"))
    model = kernel_svm.fit_kernel_svm(same, 2, 1.0, GAMMA)
    assert all(r.prediction == 0 for r in model.transform(same).collect())
    one = same.withColumn("label", F.lit(1.0))
    assert len(kernel_svm.fit_kernel_svm(one, 2, 1.0, GAMMA).weights) == 0


def test_too_many_support_vectors_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(kernel_svm, "SUPPORT_BYTES", 100)
    with pytest.raises(ValueError, match="n_fourier"):
        kernel_svm.fit_kernel_svm(noisy_rings(spark, 300), 2, 1.0, GAMMA)
