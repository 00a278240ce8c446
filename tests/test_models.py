import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sparktab.operators import estimators, modelling
from sparktab.plans import fixtures as fx
from sparktab.plans.workflows import HeldOut

SF = "/root/testdata/sf0.001"
QUICK = {
    "svm": {"kernel": "linear"},
    "random_forest": {"n_estimators": 10, "max_depth": 5},
    "adaboost": {"n_estimators": 12},
    "xgboost": {"n_estimators": 5, "max_depth": 3},
    "knn": {},
    "logistic_regression": {"max_iter": 30},
    "neural_network": {"hidden_layer_sizes": (8,), "max_iter": 30},
}


@pytest.fixture(scope="module")
def held(spark):
    out = HeldOut(fx.clf_base(spark, SF), "target", 0.2, 42, "row_id")
    yield out
    out.close()


@pytest.mark.parametrize("algorithm", sorted(QUICK))
def test_beats_the_majority_and_survives_saving(spark, held, algorithm, tmp_path):
    stages = held.fit(algorithm, QUICK[algorithm])
    measured = held.measure(stages)
    majority = max(held.counts.values()) / sum(held.counts.values())
    assert measured["accuracy"] > majority + 0.3
    assert measured["roc_auc"] > 0.9
    path = str(tmp_path / "model")
    model = held.model(stages)
    model.write().save(path)
    rows = held.test_rows.drop("label")
    columns = ["row_id", "predicted"]
    before = modelling.score(model, rows).select(*columns)
    after = modelling.score(PipelineModel.load(path), rows).select(*columns)
    assert before.exceptAll(after).count() == 0


def test_rbf_kernel_separates_rings(spark):
    df = spark.range(0, 600, 1, 1).select(
        F.col("id").alias("row_id"),
        (F.cos("id") * (1 + F.col("id") % 2 * 2)).alias("x"),
        (F.sin("id") * (1 + F.col("id") % 2 * 2)).alias("y"),
        (F.col("id") % 2).alias("target"),
    )
    held = HeldOut(df, "target", 0.2, 1, "row_id")
    assert held.measure(held.fit("svm", {"n_fourier": 32}))["accuracy"] > 0.95
    assert held.measure(held.fit("svm", {"kernel": "linear"}))["accuracy"] < 0.8
    held.close()


@pytest.mark.parametrize(
    "algorithm", ["svm", "xgboost", "adaboost", "logistic_regression"]
)
def test_three_text_classes(spark, algorithm, tmp_path):
    df = spark.range(0, 300, 1, 1).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 3 + F.pmod(F.xxhash64("id"), F.lit(100)) / 250).alias("x"),
        F.element_at(F.array(F.lit("u"), F.lit("v"), F.lit("w")), (F.col("id") % 3 + 1).cast("int")).alias("target"),
    )
    held = HeldOut(df, "target", 0.2, 1, "row_id")
    params = {**QUICK[algorithm], **({"n_estimators": 3} if algorithm == "xgboost" else {})}
    stages = held.fit(algorithm, params)
    out = held.measure(stages)
    assert out["labels"] == ["u", "v", "w"]
    assert out["accuracy"] > (0.6 if algorithm == "adaboost" else 0.9)
    model = held.model(stages)
    shares = modelling.score(model, held.test_rows.drop("label"))
    worst = shares.agg(F.max(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1)))
    assert worst.first()[0] < 1e-9
    model.write().save(str(tmp_path / "m"))
    assert PipelineModel.load(str(tmp_path / "m")).transform(held.test_rows).count() == 60
    held.close()


def test_parameters():
    assert estimators.resolve_parameters("rf", {"max_depth": 3})["n_estimators"] == 200
    with pytest.raises(ValueError, match="Unsupported"):
        estimators.resolve_parameters("bayes")
    with pytest.raises(ValueError, match="Unknown parameters"):
        estimators.resolve_parameters("svm", {"depth": 3})


def test_a_deeper_tree_than_spark_has_is_an_error():
    assert estimators.tree_depth(None) == 30 and estimators.tree_depth(8) == 8
    with pytest.raises(ValueError, match="max_depth"):
        estimators.tree_depth(31)
