"""The registered queries: each reads the given tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions import scalars
from sparktab.operators import (
    boosting,
    diagnostics,
    estimators,
    features,
    knn,
    metrics,
    positions,
    prep,
    profile,
    runs,
    scoring,
    split,
    tuning,
)
from sparktab.plans import facts, workflows
from sparktab.plans import fixtures as fx
from sparktab.session import scratch_path
from sparktab.sources import delimited, records, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that sums in a different order compare equal."""
    return df.select(
        [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# Metric rules on a fixed rule prediction and on scored rows.


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(fx.scored(spark, sf))


@query
def confusion_cells(spark, sf):
    return metrics.confusion_cells(fx.scored(spark, sf))


@query
def classification_metrics(spark, sf):
    base = fx.clf_base(spark, sf)
    ruled = base.select("target", (F.col("l_quantity") > 25).cast("int").alias("prediction"))
    return rounded(metrics.classification_metrics(ruled, "target", "prediction"))


@query
def macro_metrics(spark, sf):
    return rounded(metrics.macro_metrics(metrics.confusion_counts(fx.scored_multi(spark, sf))))


@query
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(fx.scored(spark, sf), [0, 1]))


@query
def roc_auc_ovr(spark, sf):
    return rounded(metrics.roc_auc(fx.scored_multi(spark, sf), list(range(10))))


@query
def log_loss_brier(spark, sf):
    return rounded(metrics.probability_losses(fx.scored(spark, sf), [0, 1]))


@query
def ordinal_error_metrics(spark, sf):
    return rounded(metrics.ordinal_errors(metrics.confusion_counts(fx.scored_multi(spark, sf))))


@query
def metric_payload(spark, sf):
    row = metrics.metric_payload(fx.scored(spark, sf), [0, 1])
    cells = F.flatten("confusion_matrix")
    return rounded(
        row.select(
            "accuracy",
            "error_rate",
            "precision",
            "recall",
            "f1",
            "roc_auc",
            "mae",
            "mse",
            "rmse",
            "log_loss",
            "brier_score",
            *[cells[i].alias(n) for i, n in enumerate(("tn", "fp", "fn", "tp"))],
        )
    )


@query
def roc_curve(spark, sf):
    return rounded(metrics.roc_curve(fx.scored(spark, sf), F.col("p"), F.col("label") == 1))


@query
def pr_curve(spark, sf):
    return rounded(metrics.pr_curve(fx.scored(spark, sf), F.col("p"), F.col("label") == 1))


# Sources, sinks and profiling.


@query
def csv_roundtrip_scan(spark, sf):
    path = scratch_path(spark, "csv")
    delimited.write_csv(fx.clf_nulls(spark, sf), path)
    return delimited.read_csv(spark, path)


@query
def profile_shape(spark, sf):
    return profile.shape(fx.table(spark, sf, "lineitem"))


@query
def profile_missing(spark, sf):
    return profile.missing_values(fx.clf_nulls(spark, sf))


@query
def profile_duplicates(spark, sf):
    events = fx.table(spark, sf, "events").select("event_type", "user_id")
    docs = fx.table(spark, sf, "documents").select("text", "lang")
    return (
        profile.duplicate_rows(events)
        .withColumn("source", F.lit("events"))
        .unionByName(profile.duplicate_rows(docs).withColumn("source", F.lit("documents")))
    )


@query
def profile_dtypes(spark, sf):
    return profile.dtypes_table(fx.clf_nulls(spark, sf))


@query
def target_distribution(spark, sf):
    return profile.target_distribution(fx.clf_base(spark, sf), "target")


@query
def describe_numeric(spark, sf):
    return rounded(profile.describe_numeric(fx.clf_nulls(spark, sf)), 4)


@query
def describe_categorical(spark, sf):
    return profile.describe_categorical(fx.clf_nulls(spark, sf))


@query
def column_roles(spark, sf):
    return profile.column_roles(fx.clf_nulls(spark, sf))


@query
def low_card_columns(spark, sf):
    return profile.low_cardinality_table(fx.clf_nulls(spark, sf))


@query
def histogram_15(spark, sf):
    return rounded(profile.histogram(fx.clf_nulls(spark, sf)))


@query
def correlation_matrix(spark, sf):
    return rounded(profile.correlation_matrix(fx.clf_nulls(spark, sf)))


@query
def pair_grid(spark, sf):
    return profile.pair_grid(fx.clf_nulls(spark, sf))


@query
def category_counts(spark, sf):
    return profile.category_counts(fx.clf_nulls(spark, sf))


@query
def quality_report_json(spark, sf):
    """The report written as JSON, read back, and listed as (path, value)."""
    path = scratch_path(spark, "report")
    report = profile.quality_report(fx.clf_nulls(spark, sf))
    reports.write_json_report(report, path)
    stored = spark.read.schema(report.schema).json(path)

    def entry(path, value):
        return F.struct(
            F.concat_ws(".", *path).alias("path"), value.cast("double").alias("value")
        )

    def listed(section):
        return F.transform(
            F.map_entries(section), lambda e: entry([F.lit(section), e["key"]], e["value"])
        )

    scalars = F.array(
        *[entry([F.lit(c)], F.col(c)) for c in ("shape.rows", "shape.cols", "duplicate_rows")]
    )
    stats = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    summary = F.flatten(
        F.transform(
            F.map_entries("numeric_summary"),
            lambda e: F.array(
                *[entry([F.lit("numeric_summary"), e["key"], F.lit(s)], e["value"][s]) for s in stats]
            ),
        )
    )
    parts = [scalars, listed("missing_values"), listed("target_distribution"), summary]
    return rounded(stored.select(F.inline(F.concat(*parts))), 4)


@query
def quality_report_lines(spark, sf):
    """The report written as text, read back line by line."""
    path = scratch_path(spark, "lines")
    reports.write_lines(profile.report_lines(fx.clf_nulls(spark, sf)), path)
    text = spark.read.text(path, wholetext=True)
    return text.select(
        F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line_no", "text")
    ).select(F.col("line_no").cast("bigint"), "text")


# Preparation.


@query
def preview_rows(spark, sf):
    columns = ["l_extendedprice", "l_quantity", "target"]
    return prep.preview(fx.clf_base(spark, sf), 10, columns, [1], "target", "row_id").rows


@query
def preview_shape(spark, sf):
    columns = ["l_extendedprice", "l_quantity", "target"]
    return prep.preview(fx.clf_base(spark, sf), 10, columns, [1], "target", "row_id").shape()


@query
def class_filter(spark, sf):
    return prep.class_filter(fx.clf_multi(spark, sf), "label", [1, 3, 5]).select("vec_id", "label")


@query
def prepare_dataset(spark, sf):
    columns = ["l_quantity", "l_returnflag", "l_linestatus"]
    return prep.prepare(fx.clf_nulls(spark, sf), "target", columns, [0, 1], "dropna", True, "row_id")


@query
def clean_missing_summary(spark, sf):
    return prep.clean_summary(fx.clf_nulls(spark, sf), "row_id")


# Splits and features.


@query
def stratified_split(spark, sf):
    base = fx.clf_base(spark, sf)
    counts = prep.validate(base, "target", "row_id")
    out = split.stratified_split(base, "target", "row_id", counts, 0.2, 42)
    return out.select("row_id", "target", "is_test")


@query
def stratified_folds(spark, sf):
    base = fx.clf_base(spark, sf)
    counts = prep.validate(base, "target", "row_id")
    out = split.stratified_folds(base, "target", "row_id", counts, 3, 42)
    return out.select("row_id", "target", "fold")


@query
def impute_median(spark, sf):
    df = fx.clf_nulls(spark, sf)
    model = features.MedianModeImputer(numeric=["l_quantity"]).fit(df)
    return model.transform(df).select("row_id", F.col("num__l_quantity").alias("l_quantity"))


@query
def impute_mode(spark, sf):
    df = fx.clf_nulls(spark, sf)
    model = features.MedianModeImputer(categorical=["l_returnflag"]).fit(df)
    return model.transform(df).select("row_id", F.col("cat__l_returnflag").alias("l_returnflag"))


@query
def standard_scale(spark, sf):
    df = fx.clf_base(spark, sf)
    model = features.PopulationScaler(columns=fx.NUMERIC).fit(df)
    return rounded(model.transform(df).select("row_id", *fx.NUMERIC))


def _slots(spark, sf, columns, scale=True):
    df = fx.clf_nulls(spark, sf)
    encoder = features.build_encoder(df, columns, scale).fit(df)
    names = [n for _, n, _ in features.slot_table(encoder)]
    array = vector_to_array("features")
    return rounded(
        encoder.transform(df)
        .select("row_id", array.alias("a"))
        .select("row_id", *[F.col("a")[i].alias(n) for i, n in enumerate(names)])
    )


@query
def one_hot(spark, sf):
    return _slots(spark, sf, fx.CATEGORICAL)


@query
def design_matrix(spark, sf):
    return _slots(spark, sf, fx.FEATURES)


@query
def design_matrix_unscaled(spark, sf):
    return _slots(spark, sf, fx.FEATURES, scale=False)


# Run log, on orders recast as runs.


def _entries(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id",
        "algorithm",
        "dataset_version",
        "session_id",
        "optimize_metric",
        "source",
        F.col("hyperparameters")["max_depth"].alias("max_depth"),
        F.size("hyperparameters").alias("n_parameters"),
        F.col("metrics.accuracy").alias("accuracy"),
        F.col("metrics.f1").alias("f1"),
        F.col("metrics.roc_auc").alias("roc_auc"),
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


@query
def run_metadata(spark, sf):
    """Every run record parsed, unreadable JSON included."""
    return _entries(fx.runs_fixture(spark, sf))


@query
def runs_list(spark, sf):
    listed = runs.list_runs(
        fx.runs_fixture(spark, sf), fx.run_activations(spark, sf), fx.run_deletes(spark, sf)
    )
    flag = listed.select("run_id", "is_active")
    return _entries(listed).join(flag, "run_id")


@query
def runs_oldest_first(spark, sf):
    """The newest 50 runs as a listing gives them, oldest first, with their places."""
    listed = runs.list_runs(
        fx.runs_fixture(spark, sf), fx.run_activations(spark, sf), fx.run_deletes(spark, sf), limit=50, oldest_first=True
    )
    place = F.row_number().over(Window.orderBy("start_time", "run_id"))  # of at most 50 rows
    return listed.select(place.alias("place"), "run_id", "is_active")


@query
def runs_by_algorithm(spark, sf):
    live = runs.live_runs(fx.runs_fixture(spark, sf), fx.run_deletes(spark, sf))
    return _entries(live.where(F.col("algorithm") == "2-HIGH"))


@query
def active_model(spark, sf):
    return runs.active_version(fx.run_activations(spark, sf), fx.run_deletes(spark, sf))


@query
def experiment_rollup(spark, sf):
    live = runs.live_runs(fx.runs_fixture(spark, sf), fx.run_deletes(spark, sf))
    out = runs.experiments(live)
    return out.select(
        "id",
        "dataset_version",
        "optimize_metric",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "n_results",
        F.array_join("models", ",").alias("models"),
        "best_model",
        "best_version",
    )


@query
def experiments_by_algorithm(spark, sf):
    live = runs.live_runs(fx.runs_fixture(spark, sf), fx.run_deletes(spark, sf))
    best = runs.experiments(live).where(F.col("best_model") == "5-LOW")
    return best.select("id", "best_version")


@query
def leaderboard(spark, sf):
    out = runs.leaderboard(fx.runs_fixture(spark, sf), "f1")
    return out.select("run_id", "algorithm", "score")


@query
def performance_table(spark, sf):
    return runs.performance_table(fx.runs_fixture(spark, sf).where("algorithm <> ''"))


@query
def radar_pivot(spark, sf):
    named = fx.runs_fixture(spark, sf).where("algorithm <> ''")
    models = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return runs.radar(runs.performance_table(named), models)


@query
def normalize_algorithm(spark, sf):
    """Free spellings in the orders, brought to canonical names."""
    spellings = [
        " RF ",
        "Random Forest",
        "ada boost",
        "XGB",
        "LogReg",
        "Logistic Regression",
        "SVM",
        "Knn",
        "mlp",
        "Neural Network",
        "naive bayes",
    ]
    pick = F.element_at(
        F.array(*[F.lit(s) for s in spellings]),
        (F.col("o_custkey") % len(spellings) + 1).cast("int"),
    )
    named = fx.table(spark, sf, "orders").select("o_orderkey", pick.alias("name"))
    return named.withColumn("algorithm", scalars.normalize_algorithm(F.col("name")))


@query
def run_time_ids(spark, sf):
    events = fx.table(spark, sf, "events")
    return events.select("event_id", scalars.timestamp_id(F.col("ts").cast("timestamp")).alias("id"))


# Error mining on scored rows.


@query
def misclassified_topk(spark, sf):
    out = diagnostics.misclassified_topk(fx.scored(spark, sf), fx.FEATURES, "row_id")
    return rounded(out.select("index", "true", "pred", "prob", "features.*"))


@query
def error_patterns(spark, sf):
    out = diagnostics.error_patterns(fx.scored(spark, sf), fx.NUMERIC, fx.CATEGORICAL)
    return rounded(out, 4)


# Nearest neighbours over the whole embedding table.


def _neighbour_votes(spark, sf, weights):
    df = fx.clf_multi(spark, sf)
    counts = prep.validate(df, "label", "vec_id")
    marked = split.stratified_split(df, "label", "vec_id", counts, 0.2, 42)
    train = marked.where(~F.col("is_test")).select(
        F.col("vec_id").alias("tid"), F.col("label").cast("double").alias("label"), "vec"
    )
    tested = marked.where("is_test").select(F.col("vec_id").alias("qid"), "vec")
    votes = knn.vote(knn.nearest(tested, train, 5), len(counts), weights)
    return rounded(
        votes.select(
            F.col("qid").alias("vec_id"),
            F.col("prediction").cast("int").alias("prediction"),
            F.array_max("probability").alias("share"),
        )
    )


@query
def knn_predict(spark, sf):
    return _neighbour_votes(spark, sf, "uniform")


@query
def knn_predict_weighted(spark, sf):
    return _neighbour_votes(spark, sf, "distance")


# Fitted models over the whole of clf_base, measured on the held-out fifth.


def _measured(spark, sf, algorithm, params):
    """Sizes of the held-out side per class and whether the reported metrics hold."""
    held = workflows.HeldOut(fx.clf_base(spark, sf), "target", 0.2, 42, "row_id")
    row = held.measure(held.fit(algorithm, params))
    held.close()
    return facts.held_out(spark, [(algorithm, row)])


@query
def fit_logistic(spark, sf):
    return _measured(spark, sf, "logistic_regression", {})


@query
def fit_random_forest(spark, sf):
    return _measured(spark, sf, "random_forest", {"n_estimators": 20, "max_depth": 8})


@query
def fit_gbt(spark, sf):
    return _measured(spark, sf, "xgboost", {})


@query
def fit_svm_linear(spark, sf):
    return _measured(spark, sf, "svm", {"kernel": "linear"})


@query
def fit_svm_rbf(spark, sf):
    return _measured(spark, sf, "svm", {"kernel": "rbf"})


@query
def fit_adaboost(spark, sf):
    return _measured(spark, sf, "adaboost", {})


@query
def fit_mlp(spark, sf):
    return _measured(spark, sf, "neural_network", {})


@query
def fit_knn(spark, sf):
    return _measured(spark, sf, "knn", {"n_neighbors": 5})


def _numeric_vectors(spark, sf, columns):
    cells = F.array(*[F.col(c).cast("double") for c in columns])
    return fx.clf_base(spark, sf).select("row_id", array_to_vector(cells).alias("features"), F.col("target").cast("double").alias("label"))


@query
def boosted_trees(spark, sf):
    """Cuts and leaf values of three second-order trees of depth 2 over the whole table."""
    params = estimators.resolve_parameters("xgboost", {"n_estimators": 3, "max_depth": 2, "subsample": 1.0, "colsample_bytree": 1.0})
    rows = _numeric_vectors(spark, sf, ["l_discount", "l_quantity", "l_tax"])
    model = boosting.fit_boosted(rows, {**estimators.BOOSTING, **params}, 3, "row_id")
    paths = {}
    out = []
    for tree, node, feature, threshold, left, right, value in model.nodes():
        path = paths.get((tree, node), "")
        if feature >= 0:
            paths[tree, left], paths[tree, right] = path + "L", path + "R"
        out.append((tree, path, feature, threshold, None if feature >= 0 else round(value, 6)))
    return spark.createDataFrame(out, "tree int, path string, feature int, threshold double, value double")


@query
def adaboost_stumps(spark, sf):
    """The first three stumps, cut at any value, over the whole table."""
    rows = _numeric_vectors(spark, sf, ["l_discount", "l_extendedprice", "l_quantity", "l_tax"])
    stumps = estimators.fit_adaboost(rows, 2, 3, 0.5).value("stumps")
    out = [(i, int(f), float(t), int(left), int(right), round(w, 6)) for i, (f, t, left, right, w) in enumerate(stumps)]
    return spark.createDataFrame(out, "round int, feature int, threshold double, left_class int, right_class int, weight double")


# Registry, workflows and scoring in a fresh warehouse.


def _bench(spark) -> workflows.Workbench:
    return workflows.Workbench(spark, scratch_path(spark, "warehouse"))


@query
def dataset_register(spark, sf):
    """Customers imported from CSV, then orders from Parquet: both listed, one active."""
    house = _bench(spark).warehouse
    path = scratch_path(spark, "import")
    delimited.write_csv(fx.table(spark, sf, "customer"), path)
    house.upload(path, "customers")
    house.upload(f"{sf}/orders.parquet", "orders")
    return house.list_datasets().select(
        "version", "rows", F.col("cols").cast("bigint").alias("cols"), "is_active"
    )


@query
def dataset_load_version(spark, sf):
    house = _bench(spark).warehouse
    house.register(fx.table(spark, sf, "customer"), "customers")
    return house.load_dataset("customers")


@query
def dataset_list(spark, sf):
    """A cleaned version joins its source in the list and becomes the active one."""
    house = _bench(spark).warehouse
    house.register(fx.clf_nulls(spark, sf), "lines")
    house.clean_missing("lines")
    return house.list_datasets().select(
        F.regexp_replace("version", "_clean_.*", "_clean").alias("version"),
        "rows",
        F.col("cols").cast("bigint").alias("cols"),
        "source_version",
        "rows_removed",
        "is_active",
    )


@query
def datasets_reset(spark, sf):
    """Customers and orders removed, orders seeded again: the list left and how many went."""
    house = _bench(spark).warehouse
    house.register(fx.table(spark, sf, "customer"), "customers")
    house.upload(f"{sf}/orders.parquet", "orders")
    gone = house.reset_datasets(f"{sf}/orders.parquet", "seed")["removed_dataset_files"]
    return house.list_datasets().select(
        "version", "rows", "is_active", F.lit(gone).cast("bigint").alias("removed")
    )


def _run_house(spark, sf):
    """A warehouse that holds the run records and their deletions."""
    house = _bench(spark).warehouse
    fx.runs_fixture(spark, sf).write.parquet(f"{house.root}/runs")
    fx.run_deletes(spark, sf).write.parquet(f"{house.root}/run_deletes")
    return house


@query
def runs_rollback(spark, sf):
    """The newest run active, then the first id of all again: the flags of all runs."""
    house = _run_house(spark, sf)
    house.rollback(house.list_models().first()["run_id"])
    house.rollback(house.live_runs().agg(F.min("run_id")).first()[0])
    return house.list_models().select("run_id", "algorithm", "is_active")


@query
def runs_reset(spark, sf):
    """What a reset of all runs counts, and the runs deleted afterwards."""
    house = _run_house(spark, sf)
    counts = house.reset_models()
    return house.table("run_deletes").agg(F.count_distinct("run_id").alias("deleted")).select(
        "deleted", *[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()]
    )


@query
def time_ids(spark, sf):
    """Every order's date as sortable id text."""
    orders = fx.table(spark, sf, "orders")
    made = scalars.timestamp_id(F.col("o_orderdate").cast("timestamp"))
    return orders.select("o_orderkey", made.alias("time_id"))


@query
def validated_classes(spark, sf):
    """The class counts of a prepared table that passes every check."""
    df = fx.clf_base(spark, sf)
    counts = prep.validate(prep.prepare(df, "target", row_id="row_id"), "target", "row_id")
    return spark.createDataFrame(list(counts.items()), f"target {dict(df.dtypes)['target']}, n bigint")


@query
def labels_attached(spark, sf):
    """The label of every row attached again to its features, by position."""
    df = fx.clf_base(spark, sf)
    return positions.attach(df.select("row_id", "l_quantity"), df.select("target"))


def _results_frame(spark, results):
    return facts.held_out(spark, [(r["model"], r["metrics"]) for r in results])


@query
def train_compare(spark, sf):
    """Two models on one split; the best one comes first in the ranking metric."""
    bench = _bench(spark)
    bench.warehouse.register(fx.clf_base(spark, sf).drop("row_id"), "lines")
    out = bench.train(workflows.TrainRequest("lines", models=["logreg", "rf"]))
    best = out["best_model"]["metrics"]["f1"] == max(r["metrics"]["f1"] for r in out["results"])
    active = out["best_model"]["model_version"] == bench.warehouse.active_model()
    return _results_frame(spark, out["results"]).withColumn("best_is_active", F.lit(best and active))


@query
def automl_leaderboard(spark, sf):
    """Two candidates on distinct rows; the board is in the order of the metric."""
    bench = _bench(spark)
    bench.warehouse.register(fx.clf_base(spark, sf).drop("row_id"), "lines")
    out = bench.automl(
        workflows.AutoMLRequest(
            "lines", candidate_models=["logreg", "knn"], quick_tuning=False, optimize_metric="roc_auc"
        )
    )
    board = [r["metrics"]["roc_auc"] for r in out["leaderboard"]]
    return _results_frame(spark, out["leaderboard"]).withColumn("in_order", F.lit(facts.in_order(board)))


def _tuned(spark, sf, **request):
    bench = _bench(spark)
    bench.warehouse.register(fx.clf_base(spark, sf).drop("row_id"), "lines")
    out = bench.tune(workflows.TuneRequest("lines", **request))
    best = max(v for _, v in out["trials"])
    rows = [
        (i, name, float(value), 0 < v <= 1, out["best_cv_score"] == best)
        for i, (p, v) in enumerate(out["trials"])
        for name, value in sorted(p.items())
    ]
    return spark.createDataFrame(rows, "trial int, parameter string, value double, score_holds boolean, best_holds boolean")


@query
def tune_grid(spark, sf):
    space = {"C": [0.01, 1.0], "max_iter": [30]}
    return _tuned(spark, sf, model="logreg", method="grid", search_space=space)


@query
def tune_random(spark, sf):
    space = {"n_estimators": [5, 10], "max_depth": [3, 5, 8]}
    return _tuned(spark, sf, model="rf", method="random", n_iter=2, search_space=space)


@query
def tune_sequential(spark, sf):
    """Twenty trials over the default ranges: ten random draws, then ten proposals of the density estimator. The solver,
    which has one choice, is left to its default."""
    space = {n: s for n, s in tuning.RANGE_SPACES["logistic_regression"].items() if n != "solver"}
    return _tuned(spark, sf, model="logreg", method="sequential", search_space=space)


@query
def tune_then_train(spark, sf):
    bench = _bench(spark)
    bench.warehouse.register(fx.clf_base(spark, sf).drop("row_id"), "lines")
    space = {"estimator__C": [0.01, 1.0], "estimator__max_iter": [30]}
    out = bench.tune_then_train(
        workflows.TuneRequest("lines", model="logreg", search_space=space),
        workflows.TrainRequest("lines"),
    )
    return _results_frame(spark, out["results"])


def _logged(spark, sf):
    bench = _bench(spark)
    bench.warehouse.register(fx.clf_base(spark, sf).drop("row_id"), "lines")
    request = workflows.TrainRequest("lines", models=["logreg"])
    return bench, bench.train(request)["best_model"]["model_version"]


@query
def score_saved_model(spark, sf):
    """A logged model loaded again and applied to the whole table."""
    bench, version = _logged(spark, sf)
    model = bench.warehouse.load_model(version)
    wanted = records.from_table(fx.clf_base(spark, sf), records.model_schema(model), ["row_id"])
    return facts.scored(model, fx.clf_base(spark, sf), scoring.score_table(model, wanted), "row_id")


@query
def score_records(spark, sf):
    """The whole table as JSON records."""
    bench, version = _logged(spark, sf)
    model = bench.warehouse.load_model(version)
    path = scratch_path(spark, "records")
    fx.clf_base(spark, sf).drop("target").write.json(path)
    keep = T.StructType([T.StructField("row_id", T.StringType())])
    wanted = records.read_json(spark, path, records.model_schema(model), keep)
    return facts.scored(model, fx.clf_base(spark, sf), scoring.score_table(model, wanted), "row_id")


@query
def score_records_csv(spark, sf):
    """The whole table as CSV records."""
    bench, version = _logged(spark, sf)
    model = bench.warehouse.load_model(version)
    path = scratch_path(spark, "records")
    delimited.write_csv(fx.clf_base(spark, sf).drop("target"), path)
    wanted = records.read_csv(spark, path, records.model_schema(model), ["row_id"])
    return facts.scored(model, fx.clf_base(spark, sf), scoring.score_table(model, wanted), "row_id")


# Forest diagnostics.


@query
def importance_rollup(spark, sf):
    df = fx.clf_base(spark, sf)
    part = diagnostics.ForestSplit(df, "target", prep.validate(df, "target", "row_id"), 42, "row_id")
    model = part.fit({"n_estimators": 20})
    part.close()
    rolled = diagnostics.importance_rollup(diagnostics.importance_slots(part.encoder, model.stages[0]), None)
    total = rolled.agg(F.sum("importance")).first()[0]
    return rolled.select("feature", (F.col("importance") >= 0).alias("not_negative"), F.lit(abs(total - 1) < 1e-9).alias("sums_to_one"))


@query
def seed_stability(spark, sf):
    df = fx.clf_base(spark, sf)
    scores = diagnostics.seed_scores(df, "target", diagnostics.SEEDS, {}, "row_id").persist()
    found = diagnostics.stability(scores).first()
    hold = []
    for name in ("accuracy", "f1"):
        values = [r[name] for r in scores.collect()]
        mean = sum(values) / len(values)
        spread = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
        hold.append(abs(found[f"{name}_mean"] - mean) < 1e-9 and abs(found[f"{name}_std"] - spread) < 1e-9)
    return scores.select("seed", F.col("accuracy").between(0.5, 1).alias("accuracy_holds"), F.lit(all(hold)).alias("summary_holds"))


@query
def bias_variance(spark, sf):
    df = fx.clf_base(spark, sf)
    table = diagnostics.bias_variance(df, "target", diagnostics.GRID_ESTIMATORS, diagnostics.GRID_DEPTHS, 42, "row_id")
    bias = F.abs(F.col("bias") + F.col("train_accuracy") - 1) < 1e-12
    variance = F.abs(F.col("variance") - F.col("train_accuracy") + F.col("test_accuracy")) < 1e-12
    return table.select("n_estimators", "max_depth", bias.alias("bias_holds"), variance.alias("variance_holds"), (F.col("test_accuracy") > 0.5).alias("learns"))
