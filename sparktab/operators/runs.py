"""The run log: listings, sessions, active pointer, leaderboards.

Runs, activations and deletions are append-only tables. A listing is a join of the
three, so nothing is ever rewritten and concurrent writers cannot lose entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.functions.scalars import percent, strip_parameter_prefix

METRICS = [
    "accuracy",
    "precision",
    "recall",
    "f1",
    "roc_auc",
    "error_rate",
    "mae",
    "mse",
    "rmse",
    "log_loss",
    "brier_score",
]
METRICS_TYPE = (
    "struct<"
    + ",".join(f"{m}:double" for m in METRICS)
    + ",confusion_matrix:array<array<bigint>>,labels:array<string>>"
)
RUNS_SCHEMA = (
    "run_id string, algorithm string, dataset_version string, target_column string, "
    "session_id string, optimize_metric string, source string, start_time timestamp, "
    f"hyperparameters map<string,string>, metrics {METRICS_TYPE}, model_path string"
)
ACTIVATIONS_SCHEMA = "kind string, version string, ts timestamp"
DELETES_SCHEMA = "run_id string, ts timestamp"


def parse_metadata(raw: DataFrame) -> DataFrame:
    """Run records from tags, parameters and JSON texts.

    Unreadable JSON falls back to the scalar metrics and the prefixed parameters;
    missing tags take their defaults.
    """

    def tag(name: str, default: Column) -> Column:
        return F.coalesce(F.try_element_at("tags", F.lit(name)), default)

    from_text = F.from_json("metrics_json", METRICS_TYPE)
    usable = F.coalesce(F.size(F.from_json("metrics_json", "map<string,string>")), F.lit(0)) > 0
    fallback = F.struct(
        *[F.try_element_at("metrics_base", F.lit(m)).alias(m) for m in METRICS],
        F.lit(None).cast("array<array<bigint>>").alias("confusion_matrix"),
        F.lit(None).cast("array<string>").alias("labels"),
    )
    named = F.from_json("hyperparameters_json", "map<string,string>")
    prefixed = strip_parameter_prefix(F.map_filter("params", lambda k, v: k.startswith("hp_")))
    return raw.select(
        "run_id",
        tag("model_name", F.lit("unknown")).alias("algorithm"),
        tag("dataset_version", F.lit("unknown")).alias("dataset_version"),
        tag("target_column", F.lit("target")).alias("target_column"),
        tag("session_id", F.col("run_id")).alias("session_id"),
        tag("optimize_metric", F.lit("f1")).alias("optimize_metric"),
        tag("source", F.lit("train")).alias("source"),
        "start_time",
        F.when(F.size(named) > 0, named).otherwise(prefixed).alias("hyperparameters"),
        F.when(usable, from_text).otherwise(fallback).alias("metrics"),
        F.concat(F.lit("runs:/"), "run_id", F.lit("/model")).alias("model_path"),
    )


def live_runs(runs: DataFrame, deletes: DataFrame) -> DataFrame:
    """Model runs that were not deleted."""
    return runs.where("algorithm <> ''").join(deletes.select("run_id"), "run_id", "left_anti")


def active_version(activations: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """One row ``version``: the latest activation, null once that run is deleted."""
    latest = activations.agg(
        F.max(F.struct("ts", "version")).alias("last")
    ).select(F.col("last.version").alias("version"))
    if deletes is None:
        return latest
    gone = deletes.select(F.col("run_id").alias("version"), F.lit(True).alias("gone")).distinct()
    return latest.join(gone, "version", "left").select(
        F.when(F.col("gone").isNull(), F.col("version")).alias("version")
    )


def list_runs(
    runs: DataFrame,
    activations: DataFrame,
    deletes: DataFrame,
    limit: int | None = None,
    algorithm: str | None = None,
    oldest_first: bool = False,
) -> DataFrame:
    """All runs, newest first, with an ``is_active`` flag; with a limit, the newest so many. Oldest first turns the
    same runs round."""
    listed = live_runs(runs, deletes)
    if algorithm is not None:
        listed = listed.where(F.col("algorithm") == algorithm)
    age = ["start_time", "run_id"]
    newest = listed if limit is None else listed.orderBy(*[F.desc(c) for c in age]).limit(limit)
    # The pointer is one row.
    pointer = active_version(activations, deletes).select(
        F.col("version").alias("run_id"), F.lit(True).alias("_active")
    )
    return newest.join(F.broadcast(pointer), "run_id", "left").withColumn(
        "is_active", F.coalesce("_active", F.lit(False))
    ).drop("_active").orderBy(*([F.asc(c) for c in age] if oldest_first else [F.desc(c) for c in age]))


def metric_score(metric: str) -> Column:
    """Ranking value of a metric: missing and exactly 0 both count as -1."""
    return F.coalesce(F.nullif(F.col(f"metrics.{metric}"), F.lit(0.0)), F.lit(-1.0))


def experiments(runs: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row per session: header of its newest run, start, algorithms, best run.

    Algorithms come in the order first seen from the newest run back; among equal
    scores the newest run is best. Rows are folded per session and algorithm first, so
    a session of any size is never gathered.
    """
    metrics = metrics or METRICS[:5]
    seen = F.struct("start_time", "run_id")
    header = ["dataset_version", "target_column", "optimize_metric", "source"]
    best = [
        F.max(F.struct(metric_score(m).alias("score"), "start_time", "run_id", "algorithm")).alias(
            f"best_{m}"
        )
        for m in metrics
    ]
    by_algorithm = runs.groupBy("session_id", "algorithm").agg(
        F.max(seen).alias("newest"),
        F.max(F.struct("start_time", "run_id", *header)).alias("header"),
        F.min("start_time").alias("created_at"),
        F.count(F.lit(1)).alias("n"),
        *best,
    )
    by_session = by_algorithm.groupBy("session_id").agg(
        F.max("header").alias("header"),
        F.min("created_at").alias("created_at"),
        F.sum("n").alias("n_results"),
        F.reverse(F.array_sort(F.collect_list(F.struct("newest", "algorithm")))).alias("seen"),
        *[F.max(f"best_{m}").alias(f"best_{m}") for m in metrics],
    )
    chosen = F.coalesce(
        *[F.when(F.col("header.optimize_metric") == m, F.col(f"best_{m}")) for m in metrics]
    )
    return by_session.select(
        F.col("session_id").alias("id"),
        *[F.col(f"header.{h}").alias(h) for h in header],
        "created_at",
        "n_results",
        F.transform("seen", lambda s: s["algorithm"]).alias("models"),
        chosen["algorithm"].alias("best_model"),
        chosen["run_id"].alias("best_version"),
    )


def experiment_results(runs: DataFrame) -> DataFrame:
    """All results of all sessions, one row each, newest first within a session."""
    return runs.select(
        "session_id",
        F.col("algorithm").alias("model"),
        F.col("run_id").alias("model_version"),
        "metrics",
        "hyperparameters",
        "start_time",
    ).orderBy("session_id", F.desc("start_time"), F.desc("model_version"))


def leaderboard(runs: DataFrame, metric: str) -> DataFrame:
    """Runs by descending metric; equal scores keep the order they were made in."""
    return runs.select("run_id", "algorithm", metric_score(metric).alias("score"), "start_time").orderBy(
        F.desc("score"), "start_time", "run_id"
    )


def performance_table(runs: DataFrame) -> DataFrame:
    """(model, accuracy, f1, auc) in percent, from the newest run of each algorithm."""
    last = F.max_by("metrics", F.struct("start_time", "run_id")).alias("m")
    return runs.groupBy(F.col("algorithm").alias("model")).agg(last).select(
        "model",
        percent(F.col("m.accuracy")).alias("accuracy"),
        percent(F.col("m.f1")).alias("f1"),
        percent(F.col("m.roc_auc")).alias("auc"),
    )


def radar(table: DataFrame, models: list[str]) -> DataFrame:
    """The performance table turned: one row per metric, one column per model."""
    long = table.unpivot(["model"], ["accuracy", "f1", "auc"], "metric", "value")
    return long.groupBy("metric").pivot("model", models).agg(F.first("value"))
