"""Tables, datasets and models below one root folder that all executors can reach."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.operators import prep, runs
from sparktab.operators.prep import ROW_ID
from sparktab.sources.delimited import read_csv

DATASETS_SCHEMA = (
    "version string, path string, rows bigint, cols int, created_at timestamp, "
    "source_version string, rows_removed bigint"
)
SCHEMAS = {
    "dataset_versions": DATASETS_SCHEMA,
    "activations": runs.ACTIVATIONS_SCHEMA,
    "runs": runs.RUNS_SCHEMA,
    "run_deletes": runs.DELETES_SCHEMA,
}


def now() -> datetime:
    return datetime.now(timezone.utc)


def time_id(ts: datetime) -> str:
    """UTC time as sortable id text, to the microsecond."""
    return ts.strftime("%Y%m%d_%H%M%S_%f")


class Warehouse:
    """Append-only registry tables plus dataset and model folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # Tables

    def table(self, name: str) -> DataFrame:
        """A registry table; empty while nothing was appended."""
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def append(self, name: str, rows: list[tuple]) -> None:
        df = self.spark.createDataFrame(rows, SCHEMAS[name])
        df.write.mode("append").parquet(f"{self.root}/{name}")

    def activate(self, kind: str, version: str) -> None:
        self.append("activations", [(kind, version, now())])

    # Datasets

    def _since_reset(self, rows: DataFrame, ts: str) -> DataFrame:
        """The rows made after the last reset of the datasets."""
        resets = self.table("activations").where("kind = 'dataset_reset'")
        last = resets.agg(F.max("ts")).first()[0]
        return rows if last is None else rows.where(F.col(ts) > F.lit(last))

    def dataset_versions(self) -> DataFrame:
        return self._since_reset(self.table("dataset_versions"), "created_at")

    def list_datasets(self) -> DataFrame:
        """All versions, oldest first, with ``is_active``."""
        versions = self.dataset_versions()
        active = self.active_dataset()
        return versions.withColumn(
            "is_active", F.col("version") == F.lit(active) if active else F.lit(False)
        ).orderBy("created_at", "version")

    def active_dataset(self) -> str | None:
        """The last activated version, else the last registered one."""
        versions = self.dataset_versions()
        events = self._since_reset(self.table("activations").where("kind = 'dataset'"), "ts")
        marked = events.select("version", "ts", F.lit(1).alias("kind"))
        added = versions.select("version", F.col("created_at").alias("ts"), F.lit(0).alias("kind"))
        return marked.unionByName(added).agg(F.max(F.struct("kind", "ts", "version"))["version"]).first()[0]

    def _entry(self, version: str):
        row = self.dataset_versions().where(F.col("version") == version).first()
        if row is None:
            raise ValueError(f"Dataset version not found: {version}")
        return row

    def load_dataset(self, version: str, with_row_id: bool = False) -> DataFrame:
        """The typed table of a version."""
        path = self._entry(version)["path"]
        try:
            df = self.spark.read.parquet(path)
        except AnalysisException as error:
            raise FileNotFoundError(f"Dataset file missing: {path}") from error
        return df if with_row_id else df.drop(ROW_ID)

    def _store(self, df: DataFrame, version: str, source: str | None, removed: int | None):
        path = f"{self.root}/datasets/{version}"
        df.write.parquet(path)
        stored = self.spark.read.parquet(path)
        created = now()
        cols = len([c for c in stored.columns if c != ROW_ID])
        entry = (version, path, stored.count(), cols, created, source, removed)
        self.append("dataset_versions", [entry])
        self.activate("dataset", version)
        return dict(zip([f.name for f in T._parse_datatype_string(DATASETS_SCHEMA)], entry)) | {
            "is_active": True
        }

    def register(self, df: DataFrame, version: str | None = None) -> dict:
        """Store a table as a new active version.

        Every row gets a stable id in file order, which later fixes "first rows",
        splits and ties.
        """
        version = version or f"dataset_{time_id(now())}"
        numbered = df.select(F.monotonically_increasing_id().alias(ROW_ID), *df.columns)
        return self._store(numbered, version, None, None)

    def upload(self, path: str, version: str | None = None) -> dict:
        """Import a CSV (typed on the way in) or Parquet file as a new active version."""
        if path.endswith(".parquet"):
            return self.register(self.spark.read.parquet(path), version)
        return self.register(read_csv(self.spark, path), version)

    def bootstrap(self, path: str, version: str) -> dict | None:
        """Seed an empty registry from a default file, if that file is there."""
        if not self.dataset_versions().isEmpty() or not self._exists(path):
            return None
        return self.upload(path, version)

    def clean_missing(self, version: str, strategy: str = "dropna") -> dict:
        """A new active version without incomplete rows, or an unchanged copy."""
        if strategy not in ("dropna", "none"):
            raise ValueError(f"Unknown cleaning strategy: {strategy}")
        df = self.load_dataset(version, with_row_id=True)
        removed = 0
        if strategy == "dropna":
            removed = prep.clean_summary(df).first()["rows_removed"]
            df = prep.drop_missing(df)
        return self._store(df, f"{version}_clean_{time_id(now())}", version, removed)

    def preview(
        self,
        version: str,
        limit: int = 10,
        selected_columns: list[str] | None = None,
        selected_classes: list | None = None,
        target_column: str = "target",
    ) -> dict:
        """Columns, shape of the filtered table and its first rows."""
        view = prep.preview(
            self.load_dataset(version, with_row_id=True),
            limit,
            selected_columns,
            selected_classes,
            target_column,
        )
        return {
            "columns": view.columns,
            "shape": [view.filtered.count(), len(view.columns)],
            "rows": [r.asDict() for r in view.rows.collect()],
        }

    def reset_datasets(self, default_path: str | None = None, default_version: str = "default") -> dict:
        """Remove all versions; seed again from the default file if one is given."""
        removed = self.dataset_versions().count()
        self.activate("dataset_reset", "")
        self._delete(f"{self.root}/datasets")
        if default_path is not None:
            self.bootstrap(default_path, default_version)
        return {
            "removed_dataset_files": removed,
            "dataset_registry_entries": self.dataset_versions().count(),
            "active_dataset": self.active_dataset(),
        }

    # Models

    def add_run(self, record: dict, model: PipelineModel | None = None) -> str:
        """Save the model, append the run and make it active."""
        run_id = uuid.uuid4().hex
        path = f"{self.root}/models/{run_id}"
        if model is not None:
            model.write().save(path)
        self.append(
            "runs",
            [
                (
                    run_id,
                    record["algorithm"],
                    record["dataset_version"],
                    record["target_column"],
                    record["session_id"],
                    record["optimize_metric"],
                    record["source"],
                    now(),
                    {k: str(v) for k, v in record["hyperparameters"].items()},
                    record["metrics"],
                    path,
                )
            ],
        )
        self.activate("model", run_id)
        return run_id

    def _model_activations(self) -> DataFrame:
        return self.table("activations").where("kind = 'model'")

    def live_runs(self) -> DataFrame:
        return runs.live_runs(self.table("runs"), self.table("run_deletes"))

    def list_models(self, algorithm: str | None = None, limit: int | None = None) -> DataFrame:
        """The newest runs, newest first."""
        return runs.list_runs(
            self.table("runs"), self._model_activations(), self.table("run_deletes"), limit, algorithm
        )

    def list_experiments(self, algorithm: str | None = None) -> DataFrame:
        """Sessions, newest first; ``algorithm`` keeps those whose best model has it."""
        sessions = runs.experiments(self.live_runs())
        if algorithm is not None:
            sessions = sessions.where(F.col("best_model") == algorithm)
        return sessions.orderBy(F.desc("created_at"), "id")

    def active_model(self) -> str | None:
        return runs.active_version(self._model_activations(), self.table("run_deletes")).first()[0]

    def rollback(self, version: str) -> dict:
        """Make an existing run the active one."""
        row = self.live_runs().where(F.col("run_id") == version).first()
        if row is None:
            raise ValueError(f"Model version not found: {version}")
        self.activate("model", version)
        return row.asDict(recursive=True) | {"is_active": True}

    def delete_runs(self, versions: list[str]) -> None:
        if versions:
            self.append("run_deletes", [(v, now()) for v in versions])

    def reset_models(self) -> dict:
        """Mark every run as deleted."""
        live = self.live_runs()
        gone = live.count()
        live.select("run_id", F.current_timestamp().alias("ts")).write.mode("append").parquet(
            f"{self.root}/run_deletes"
        )
        return {
            "removed_model_files": gone,
            "model_registry_entries": self.live_runs().count(),
            "experiment_entries": runs.experiments(self.live_runs()).count(),
        }

    def load_model(self, version: str) -> PipelineModel:
        row = self.live_runs().where(F.col("run_id") == version).first()
        if row is None:
            raise ValueError(f"Model version not found: {version}")
        return PipelineModel.load(row["model_path"])

    # Files

    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def _delete(self, path: str) -> None:
        if not path.startswith(self.root + "/"):
            raise ValueError(f"Refusing to delete outside the warehouse: {path}")
        fs, target = self._fs(path)
        fs.delete(target, True)
