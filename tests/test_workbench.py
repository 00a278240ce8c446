"""Registry, workflows and scoring through the verbs of the toolkit."""

import pytest
from pyspark.sql import functions as F

from sparktab.functions.scalars import algorithm_name
from sparktab.operators import tuning
from sparktab.plans.workflows import AutoMLRequest, TrainRequest, TuneRequest, Workbench
from sparktab.session import scratch_path
from sparktab.sources import delimited, records
from sparktab.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def table(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    return spark.range(400).select(
        (noise + (F.col("id") % 2) * 0.8).alias("x"),
        F.when(F.col("id") % 10 != 3, F.col("id") % 5).alias("y"),
        F.when(F.col("id") % 4 == 0, "red").otherwise("blue").alias("colour"),
        (F.col("id") % 2).alias("target"),
    )


@pytest.fixture(scope="module")
def bench(spark, table):
    out = Workbench(spark, scratch_path(spark, "bench"))
    out.warehouse.register(table, "t")
    return out


def test_csv_tokens_and_types(spark, tmp_path):
    text = 'a,b,c,d,e\n1,1.5,True,x,NA\n,NaN,False,"q, ""r""",\n-3,1e3,TRUE,null,N/A\n'
    (tmp_path / "t.csv").write_text(text)
    df = delimited.read_csv(spark, str(tmp_path / "t.csv"))
    kinds = dict(df.dtypes)
    assert kinds == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "double"}
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, "x", None),
        (None, None, False, 'q, "r"', None),
        (-3, 1000.0, True, None, None),
    ]


def test_registry_life(spark, table):
    house = Workbench(spark, scratch_path(spark, "registry")).warehouse
    assert house.list_datasets().count() == 0 and house.active_dataset() is None
    path = scratch_path(spark, "default")
    delimited.write_csv(table, path)
    assert house.bootstrap(path, "first")["rows"] == 400
    assert house.bootstrap(path, "again") is None
    entry = house.clean_missing("first")
    assert entry["rows_removed"] == 40 and entry["rows"] == 360 and entry["cols"] == 4
    assert house.active_dataset() == entry["version"]
    copy = house.clean_missing("first", "none")
    assert copy["rows_removed"] == 0 and copy["rows"] == 400
    view = house.preview("first", 3, ["x", "target"], [1])
    assert view["shape"] == [200, 2] and len(view["rows"]) == 3
    assert house.load_dataset("first").columns == table.columns
    with pytest.raises(ValueError, match="not found"):
        house.load_dataset("nope")
    with pytest.raises(ValueError, match="strategy"):
        house.clean_missing("first", "other")
    assert house.reset_datasets(path, "first") == {
        "removed_dataset_files": 3,
        "dataset_registry_entries": 1,
        "active_dataset": "first",
    }


def test_train_log_rollback_predict(spark, bench, table):
    request = TrainRequest(
        "t",
        models=["logreg", "rf"],
        hyperparameters={
            "random_forest": {"n_estimators": 5, "max_depth": 3},
            "rf": {"n_estimators": 1},
        },
    )
    out = bench.train(request)
    assert [r["model"] for r in out["results"]] == ["logistic_regression", "random_forest"]
    assert out["results"][1]["hyperparameters"] == {"n_estimators": 5, "max_depth": 3}
    best = out["best_model"]
    assert best["metrics"]["f1"] == max(r["metrics"]["f1"] for r in out["results"])
    house = bench.warehouse
    assert house.active_model() == best["model_version"]
    other = next(r for r in out["results"] if r is not best)["model_version"]
    assert house.rollback(other)["run_id"] == other and house.active_model() == other
    listed = house.list_models().collect()
    assert {r["run_id"]: r["is_active"] for r in listed} == {other: True, best["model_version"]: False}
    session = house.list_experiments().first()
    assert session["best_version"] == best["model_version"] and session["n_results"] == 2
    assert session["models"] == ["random_forest", "logistic_regression"]
    rows = [{"x": 0.1, "y": 2, "colour": "red"}, {"x": 1.7, "y": None, "colour": "green"}]
    scored = bench.predict(best["model_version"], rows).collect()
    assert [r["predicted"] for r in scored] == [0, 1]
    assert scored[0]["probability"] < 0.5 < scored[1]["probability"]
    assert bench.predict(other, table).count() == 400
    assert bench.classes(other) == [0, 1]
    house.delete_runs([other])
    assert house.active_model() is None and house.list_models().count() == 1
    with pytest.raises(ValueError, match="not found"):
        house.rollback(other)
    assert house.reset_models()["model_registry_entries"] == 0


def test_tune_and_train(bench):
    search = TuneRequest("t", model="logreg", search_space={"C": [0.001, 1.0], "max_iter": [20]})
    out = bench.tune_then_train(search, TrainRequest("t", hyperparameters={"logistic_regression": {"max_iter": 5}}))
    assert set(out["tuned"]["best_params"]) == {"estimator__C", "estimator__max_iter"}
    assert out["best_model"]["hyperparameters"]["max_iter"] == 20


def test_automl_keeps_the_winner(bench):
    request = AutoMLRequest(
        "t", candidate_models=["knn", "logreg"], quick_tuning=False, optimize_metric="accuracy"
    )
    out = bench.automl(request)
    scores = [r["metrics"]["accuracy"] for r in out["leaderboard"]]
    assert scores == sorted(scores, reverse=True) and len(scores) == 2
    live = [r["run_id"] for r in bench.warehouse.live_runs().collect()]
    assert out["best_model"]["model_version"] in live
    assert out["leaderboard"][1]["model_version"] not in live


def test_records_from_files(spark, bench, tmp_path):
    version = bench.train(TrainRequest("t", models=["logreg"]))["best_model"]["model_version"]
    model = bench.warehouse.load_model(version)
    schema = records.model_schema(model)
    (tmp_path / "r.csv").write_text("id, x , y,colour\n7, 1.5 ,3, red\n8,,1,blue\n")
    table = records.read_csv(spark, str(tmp_path / "r.csv"), schema, ["id"])
    assert [(r["id"], r["x"], r["y"], r["colour"]) for r in table.collect()] == [
        ("7", 1.5, 3.0, "red"),
        ("8", None, 1.0, "blue"),
    ]
    (tmp_path / "r.json").write_text('[{"x": 1.5, "y": 3, "colour": "red"}]')
    assert records.read_json(spark, str(tmp_path / "r.json"), schema).count() == 1
    (tmp_path / "empty.csv").write_text("x,y,colour\n")
    with pytest.raises(ValueError):
        records.read_csv(spark, str(tmp_path / "empty.csv"), schema)
    with pytest.raises(ValueError):
        records.from_rows(spark, [], schema)
    with pytest.raises(ValueError, match="lack columns"):
        records.from_rows(spark, [{"x": 1}], schema)
    table.drop("id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = score_stream(model, stream).writeStream.format("memory").queryName("scored_stream").start()
    out.processAllAvailable()
    out.stop()
    assert spark.table("scored_stream").count() == 2


def test_search_helpers():
    space = {"b": [1, 2, 3], "a": ["x", "y"]}
    grid = tuning.expand_grid(space)
    assert len(grid) == 6 and grid[0] == {"a": "x", "b": 1}
    drawn = tuning.random_candidates(space, 4, 1)
    assert len(drawn) == 4 and len({str(d) for d in drawn}) == 4
    assert len(tuning.random_candidates(space, 50, 1)) == 6
    assert tuning.resolve_scoring("f1", 3) == "f1_macro" and tuning.resolve_scoring("f1", 2) == "f1"
    proposer = tuning.SequentialProposer(
        {"c": tuning.FloatRange(1e-3, 10.0, log=True), "n": tuning.IntRange(1, 9), "k": tuning.Choice(("p", "q"))}
    )
    for _ in range(60):
        p = proposer.ask()
        assert 1e-3 <= p["c"] <= 10 and 1 <= p["n"] <= 9 and p["k"] in ("p", "q")
        proposer.tell(p, -abs(p["n"] - 7) - (p["k"] == "q"))
    late = [p for p, _ in proposer.trials[-15:]]
    assert sum(abs(p["n"] - 7) <= 1 and p["k"] == "p" for p in late) >= 8
    assert algorithm_name(" Random Forest ") == "random_forest"
