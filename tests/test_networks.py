"""The network: gradients, training that stops, sums that do not depend on the blocks."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparktab.operators import networks
from sparktab.operators.estimators import DEFAULTS

P = {**DEFAULTS["neural_network"], "hidden_layer_sizes": (16, 8), "learning_rate_init": 0.01, "max_iter": 60}


def rings(spark, n=1200):
    r = 1 + F.col("id") % 2 * 2
    x = F.array(F.cos("id") * r, F.sin("id") * r)
    return spark.range(0, n, 1, 4).select(array_to_vector(x).alias("features"), (F.col("id") % 2).cast("double").alias("label"), "id")


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    sizes = [3, 5, 4, 3]
    vector = networks.flat(networks.start(sizes, 1))
    x, label = rng.standard_normal((20, 3)), rng.integers(0, 3, 20)
    loss, grad = networks.gradient(networks.shaped(vector, sizes), x, label)
    for i in range(len(vector)):
        near = [networks.gradient(networks.shaped(vector + s * 1e-6 * (np.arange(len(vector)) == i), sizes), x, label)[0] for s in (1, -1)]
        assert np.isclose(grad[i], (near[0] - near[1]) / 2e-6, rtol=1e-3, atol=1e-5)
    assert np.isclose(networks.forward(networks.shaped(vector, sizes), x)[-1].sum(axis=1), 1).all()


def test_one_step_equals_adam_on_the_whole_batch(spark):
    """With one batch an epoch is one Adam step on the mean gradient."""
    df = rings(spark, 150)
    model = networks.fit_network(df, 2, 2, {**P, "max_iter": 1, "early_stopping": False}, "id")
    rows = df.collect()
    x, label = np.array([r.features.toArray() for r in rows]), np.array([int(r.label) for r in rows])
    sizes = [2, 16, 8, 2]
    weights = networks.start(sizes, P["random_state"])
    vector = networks.flat(weights)
    counted = networks.flat([(np.ones_like(w), np.zeros_like(b)) for w, b in weights])
    grad = (networks.gradient(weights, x, label)[1] + networks.PENALTY * counted * vector) / len(x)
    first, second = 0.1 * grad, 0.001 * grad * grad
    wanted = vector - 0.01 * np.sqrt(1 - 0.999) / (1 - 0.9) * first / (np.sqrt(second) + 1e-8)
    assert np.allclose(model.value("weights"), wanted, atol=1e-8)


def test_learns_rings_stops_early_and_survives_saving(spark, tmp_path):
    df = rings(spark)
    model = networks.fit_network(df, 2, 2, {**P, "max_iter": 200}, "id")
    assert model.value("epochs") < 200 and model.value("best") > 0.98
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    out = PipelineModel.load(str(tmp_path / "m")).transform(df)
    assert out.where("prediction = label").count() > 0.98 * 1200
    shares = [r.probability for r in out.collect()]
    assert all(abs(p[0] + p[1] - 1) < 1e-9 for p in shares)


def test_sums_do_not_depend_on_blocks(spark):
    df = rings(spark, 500)
    sizes = [2, 16, 8, 2]
    weights = networks.start(sizes, 3)
    got = [networks.summed(networks.packed(df.repartition(k), 2, "id", 1, rows), weights, sizes, True) for k, rows in ((1, 4096), (5, 32))]
    assert got[0][0] == got[1][0] == 500
    assert np.allclose(got[0][1], got[1][1]) and np.allclose(got[0][2], got[1][2])


@pytest.mark.parametrize("early", [True, False])
def test_three_classes(spark, early):
    df = spark.range(600).select(
        array_to_vector(F.array((F.col("id") % 3).cast("double"), F.lit(1.0))).alias("features"), (F.col("id") % 3).cast("double").alias("label"), "id"
    )
    model = networks.fit_network(df, 2, 3, {**P, "hidden_layer_sizes": (8,), "learning_rate_init": 0.1, "max_iter": 80, "early_stopping": early}, "id")
    assert model.transform(df).where("prediction = label").count() == 600


def test_batches_are_jobs_over_their_own_partitions(spark, monkeypatch):
    """Every epoch deals all partitions to its batches, and a batch reads no others."""
    asked = []
    whole = networks.summed

    def counted(blocks, weights, sizes, with_gradient, partitions=None):
        out = whole(blocks, weights, sizes, with_gradient, partitions)
        if with_gradient:
            asked.append((tuple(partitions), out[0], blocks.getNumPartitions()))
        return out

    monkeypatch.setattr(networks, "summed", counted)
    networks.fit_network(rings(spark, 1000), 2, 2, {**P, "max_iter": 2, "early_stopping": False}, "id")
    assert len(asked) == 2 * 5 and sum(n for _, n, _ in asked) == 2 * 1000
    first, second = asked[:5], asked[5:]
    for epoch in (first, second):
        assert sorted(k for parts, *_ in epoch for k in parts) == list(range(epoch[0][2]))
    assert {parts for parts, *_ in first} != {parts for parts, *_ in second}
    assert networks.tasks_of_batch(10**7, 3000, 200) == 77 and networks.tasks_of_batch(10**7, 10**7, 200) == 16
