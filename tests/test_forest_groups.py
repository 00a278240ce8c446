import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from sparktab.operators import diagnostics, estimators, metrics


def vectors(spark):
    rows = [(Vectors.dense([i % 17 / 17.0, i % 5 / 5.0]), float(i % 17 + i % 5 > 10)) for i in range(400)]
    return spark.createDataFrame(rows, ["features", "label"])


def test_groups_of_trees():
    assert estimators.forest_groups(200, 2_000_000) == [200]
    assert sum(estimators.forest_groups(200, 30_000_000)) == 200
    assert max(estimators.forest_groups(200, 30_000_000)) <= 18
    assert estimators.forest_groups(25, 10**9) == [9, 8, 8]


def test_groups_of_trees_vote_as_one_forest(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(estimators, "FOREST_COUNTS", 1)
    monkeypatch.setattr(estimators, "LEAST_TREES", 2)
    df = vectors(spark)
    p = estimators.resolve_parameters("random_forest", {"n_estimators": 5, "max_depth": 3})
    forest = estimators.fit_classifier("random_forest", df, 2, {"n_estimators": 5, "max_depth": 3})[0]
    assert [part.getNumTrees for part in forest.parts] == [2, 2, 1] and forest.getNumTrees == 5
    assert abs(forest.featureImportances.toArray().sum() - 1) < 1e-9
    trees = [t for part in forest.parts for t in part.trees]
    scored = forest.transform(df)
    for row in scored.select("features", vector_to_array("probability").alias("p"), "prediction").take(20):
        votes = [t.predictProbability(row["features"]).toArray() for t in trees]
        wanted = sum(votes) / len(votes)
        assert row["p"] == pytest.approx(wanted.tolist())
        assert row["prediction"] == float(wanted.argmax())
    path = str(tmp_path / "forest")
    PipelineModel([forest]).write().save(path)
    again = PipelineModel.load(path).transform(df)
    assert again.select("probability").exceptAll(scored.select("probability")).count() == 0
    assert not estimators._random_forest(p).getCacheNodeIds()
    assert estimators._random_forest({**p, "max_depth": None}).getCacheNodeIds()


def test_forests_of_a_sweep_share_their_trees(spark, monkeypatch):
    df = vectors(spark).selectExpr("monotonically_increasing_id() as row_id", "cast(label as int) as target", "features", "label")
    table = df.select("row_id", "target", vector_to_array("features")[0].alias("a"), vector_to_array("features")[1].alias("b"))
    fitted = []
    fit = diagnostics.ForestSplit.fit

    def counted(self, params):
        fitted.append((params["n_estimators"], params["max_depth"], params["random_state"]))
        return fit(self, params)

    monkeypatch.setattr(diagnostics.ForestSplit, "fit", counted)
    found = diagnostics.bias_variance(table, "target", [4, 1, 2], [2, None], 42, "row_id").collect()
    assert [(r["n_estimators"], r["max_depth"]) for r in found] == [(n, d) for n in (4, 1, 2) for d in ("2", "None")]
    assert sorted(n for n, depth, _ in fitted if depth == 2) == [1, 1, 2] and len(set(fitted)) == 6
    assert (1, 2, 42) in fitted and (1, None, 42) in fitted


def test_staged_accuracies_are_those_of_the_joined_forests(spark, monkeypatch):
    df = vectors(spark)
    plain = [estimators.fit_classifier("random_forest", df, 2, {"n_estimators": n, "max_depth": 2, "random_state": n})[0] for n in (1, 2)]
    monkeypatch.setattr(estimators, "FOREST_COUNTS", 1)
    monkeypatch.setattr(estimators, "LEAST_TREES", 2)
    stages = [*plain, estimators.fit_classifier("random_forest", df, 2, {"n_estimators": 3, "max_depth": 2, "random_state": 9})[0]]
    joined = [stages[0], estimators.ForestGroups(stages[:2]), estimators.ForestGroups([*stages[:2], *stages[2].parts])]
    wanted = [metrics.classification_metrics(forest.transform(df)).first()["accuracy"] for forest in joined]
    assert diagnostics.staged_accuracies(stages, df) == wanted
