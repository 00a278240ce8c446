"""Train, tune, automatic selection and forest analysis over versioned tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.functions.scalars import ALGORITHMS, algorithm_name, strip_prefix
from sparktab.operators import diagnostics, metrics, prep, split, tuning
from sparktab.operators.estimators import fit_classifier
from sparktab.operators.features import build_encoder, route_columns
from sparktab.operators.modelling import (
    assemble,
    feature_columns_of,
    model_classes,
    stored_encoded,
    with_class_number,
)
from sparktab.operators.prep import ROW_ID
from sparktab.operators.scoring import score_table
from sparktab.session import remove, store
from sparktab.sources import records
from sparktab.sources.warehouse import Warehouse, now, time_id


@dataclass
class Selection:
    """Which rows and columns of which version."""

    dataset_version: str
    target_column: str = "target"
    selected_columns: list[str] | None = None
    selected_classes: list | None = None
    clean_missing: str = "none"
    drop_duplicates: bool = False
    random_state: int = 42


@dataclass
class TrainRequest(Selection):
    models: list[str] = field(default_factory=lambda: ["svm", "random_forest"])
    test_size: float = 0.2
    hyperparameters: dict[str, dict] = field(default_factory=dict)
    optimize_metric: str = "f1"


@dataclass
class TuneRequest(Selection):
    model: str = "random_forest"
    method: str = "grid"
    cv: int = 3
    scoring: str = "f1"
    n_iter: int = 20
    n_trials: int = 20
    search_space: dict | None = None


@dataclass
class AutoMLRequest(Selection):
    drop_duplicates: bool = True
    candidate_models: list[str] | None = None
    optimize_metric: str = "f1"
    quick_tuning: bool = True
    test_size: float = 0.2


RANKING_METRICS = ("accuracy", "f1", "roc_auc")


def ranking(result: dict, metric: str) -> float:
    """Missing and zero both rank last."""
    return result["metrics"].get(metric) or -1


class HeldOut:
    """A prepared table split once; the encoder is fitted once on the training side and
    both encoded sides are stored for every candidate model."""

    def __init__(
        self, df: DataFrame, target: str, test_size: float, seed: int, row_id: str = ROW_ID
    ):
        self.target, self.row_id = target, row_id
        self.label_type = df.schema[target].dataType.simpleString()
        self.counts = prep.validate(df, target, row_id)
        self.classes = list(self.counts)
        self.features = feature_columns_of(df, target, row_id)
        numbered = with_class_number(df, target, self.classes)
        plan = build_encoder(numbered, self.features)
        marked, at = store(split.stratified_split(numbered, target, row_id, self.counts, test_size, seed), "split")
        self.train_rows = marked.where(~F.col("is_test")).drop("is_test")
        self.test_rows = marked.where("is_test").drop("is_test")
        self.encoder = plan.fit(self.train_rows)
        (self.train, self.test), paths = stored_encoded([self.train_rows, self.test_rows], self.encoder, row_id, target)
        self._paths = [at, *paths]

    def train_counts(self) -> dict:
        return prep.validate(self.train_rows.drop("label"), self.target, self.row_id)

    def fit(self, algorithm: str, params: dict) -> list:
        return fit_classifier(algorithm, self.train, len(self.classes), params, self.row_id)

    def model(self, stages: list) -> PipelineModel:
        return assemble(self.encoder, stages, self.classes, self.label_type)

    def measure(self, stages: list) -> dict:
        """The metric payload on the held-out side."""
        tail = self.model(stages).stages[len(self.encoder.stages) :]
        scored = (
            PipelineModel(tail)
            .transform(self.test)
            .select(self.target, "predicted", vector_to_array("probability").alias("probability"))
            .persist()
        )
        try:
            payload = metrics.metric_payload(
                scored, self.classes, self.target, "predicted", "probability"
            )
            out = payload.first().asDict()
        finally:
            scored.unpersist()
        out["labels"] = [str(c) for c in out["labels"]]
        return out

    def close(self) -> None:
        remove(self.train.sparkSession, *self._paths)


class Workbench:
    """The verbs of the toolkit over one warehouse."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.warehouse = Warehouse(spark, root)

    # Preparation

    def _prepared(self, request: Selection) -> DataFrame:
        df = self.warehouse.load_dataset(request.dataset_version, with_row_id=True)
        return prep.prepare(
            df,
            request.target_column,
            request.selected_columns,
            request.selected_classes,
            request.clean_missing,
            request.drop_duplicates,
        )

    # Models

    def _fit_and_log(
        self, held: HeldOut, algorithm: str, params: dict, request, session: str, source: str
    ) -> dict:
        stages = held.fit(algorithm, params)
        measured = held.measure(stages)
        version = self.warehouse.add_run(
            {
                "algorithm": algorithm,
                "dataset_version": request.dataset_version,
                "target_column": request.target_column,
                "session_id": session,
                "optimize_metric": request.optimize_metric,
                "source": source,
                "hyperparameters": params,
                "metrics": measured,
            },
            held.model(stages),
        )
        return {
            "model": algorithm,
            "model_version": version,
            "metrics": measured,
            "hyperparameters": params,
        }

    def train(self, request: TrainRequest) -> dict:
        """Fit the listed models on one split, log each, activate the best."""
        if request.optimize_metric not in RANKING_METRICS:
            raise ValueError(f"Unknown metric: {request.optimize_metric}")
        names = [algorithm_name(m) for m in request.models]
        held = HeldOut(
            self._prepared(request), request.target_column, request.test_size, request.random_state
        )
        session = f"exp_{time_id(now())}"
        try:
            results = [
                self._fit_and_log(
                    held, m, strip_prefix(request.hyperparameters.get(m, {})), request, session, "train"
                )
                for m in names
            ]
        finally:
            held.close()
        best = max(results, key=lambda r: ranking(r, request.optimize_metric))
        self.warehouse.activate("model", best["model_version"])
        return {"experiment_id": session, "best_model": best, "results": results}

    def tune(self, request: TuneRequest) -> dict:
        """Best parameters of one model by mean fold score over all prepared rows."""
        df = self._prepared(request)
        counts = prep.validate(df, request.target_column)
        scorer = tuning.FoldScorer(
            df,
            request.target_column,
            counts,
            request.model,
            3 if request.method == "automl_quick" else request.cv,
            request.scoring,
            request.random_state,
        )
        try:
            trials = tuning.search(
                scorer,
                request.method,
                request.search_space,
                request.n_iter,
                request.n_trials,
                request.random_state,
            )
        finally:
            scorer.close()
        params, value = tuning.best_trial(trials)
        return {
            "model": scorer.algorithm,
            "method": request.method,
            "best_params": {f"estimator__{k}": v for k, v in params.items()},
            "best_cv_score": float(value),
            "trials": trials,
        }

    def tune_then_train(self, tune: TuneRequest, train: TrainRequest) -> dict:
        """Train one model with the parameters a search found."""
        tuned = self.tune(tune)
        name = tuned["model"]
        merged = {
            **strip_prefix(train.hyperparameters.get(name, {})),
            **strip_prefix(tuned["best_params"]),
        }
        return self.train(
            replace(train, models=[name], hyperparameters={**train.hyperparameters, name: merged})
        ) | {"tuned": tuned}

    def automl(self, request: AutoMLRequest) -> dict:
        """Rank candidate models on one split and keep only the winner.

        The optional quick search sees the training side only.
        """
        if request.optimize_metric not in RANKING_METRICS:
            raise ValueError(f"Unknown metric: {request.optimize_metric}")
        names = [algorithm_name(m) for m in request.candidate_models or ALGORITHMS]
        held = HeldOut(
            self._prepared(request), request.target_column, request.test_size, request.random_state
        )
        session = f"exp_automl_{time_id(now())}"
        results = []
        try:
            counts = held.train_counts() if request.quick_tuning else {}
            for name in names:
                params: dict = {}
                if request.quick_tuning:
                    scorer = tuning.FoldScorer(
                        held.train_rows.drop("label"),
                        request.target_column,
                        counts,
                        name,
                        3,
                        request.optimize_metric,
                        request.random_state,
                    )
                    try:
                        trials = tuning.search(scorer, "automl_quick", seed=request.random_state)
                    finally:
                        scorer.close()
                    params = tuning.best_trial(trials)[0]
                results.append(self._fit_and_log(held, name, params, request, session, "automl"))
        finally:
            held.close()
        board = sorted(results, key=lambda r: -ranking(r, request.optimize_metric))
        best = board[0]
        self.warehouse.delete_runs([r["model_version"] for r in board[1:]])
        self.warehouse.activate("model", best["model_version"])
        return {
            "experiment_id": session,
            "best_model": best,
            "leaderboard": board,
            "optimize_metric": request.optimize_metric,
        }

    def predict(self, version: str, rows: list[dict] | DataFrame) -> DataFrame:
        """Score records or a whole table with a logged model."""
        model = self.warehouse.load_model(version)
        schema = records.model_schema(model)
        if isinstance(rows, DataFrame):
            return score_table(model, records.from_table(rows, schema))
        return score_table(model, records.from_rows(self.spark, rows, schema))

    def classes(self, version: str) -> list:
        return model_classes(self.warehouse.load_model(version))

    def reset(self, default_path: str | None = None, default_version: str = "default") -> dict:
        """Forget all runs and datasets, optionally seeding a default dataset again."""
        return {
            "models": self.warehouse.reset_models(),
            "datasets": self.warehouse.reset_datasets(default_path, default_version),
        }


def forest_analysis(
    df: DataFrame,
    target: str,
    seed: int = 42,
    params: dict | None = None,
    seeds: list[int] = diagnostics.SEEDS,
    estimators: list[int] = diagnostics.GRID_ESTIMATORS,
    depths: list[int | None] = diagnostics.GRID_DEPTHS,
    row_id: str = ROW_ID,
) -> dict[str, DataFrame]:
    """Importance, stability, confident errors, error patterns and the bias/variance grid."""
    counts = prep.validate(df, target, row_id)
    part = diagnostics.ForestSplit(df, target, counts, seed, row_id)
    model = part.fit({**(params or {}), "random_state": seed})
    slots = diagnostics.importance_slots(part.encoder, model.stages[0])
    top = diagnostics.importance_rollup(slots)
    scored = diagnostics.scored_forest(part, model)
    features = feature_columns_of(df, target, row_id)
    numeric, _ = route_columns(df, features)
    leading = [r["feature"] for r in top.collect()]
    return {
        "top_slots": diagnostics.top_slots(slots),
        "top3_features": top,
        "stability": diagnostics.stability(
            diagnostics.seed_scores(df, target, seeds, params, row_id)
        ),
        "misclassified_examples": diagnostics.misclassified_topk(scored, features, row_id),
        "error_patterns": diagnostics.error_patterns(
            scored,
            [c for c in leading if c in numeric],
            [c for c in leading if c not in numeric],
        ),
        "bias_variance_table": diagnostics.bias_variance(df, target, estimators, depths, seed, row_id),
    }

