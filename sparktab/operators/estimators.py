"""The seven classifier families on an encoded table.

Input columns: ``features`` (vector), ``label`` (class number as double) and the row
id. Every fit returns a list of fitted stages that add ``prediction`` and
``probability``, ready to follow the encoder in a ``PipelineModel``.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.functions.scalars import algorithm_name
from sparktab.operators import knn
from sparktab.operators.boosting import DRIVER_BYTES, MAX_BINS, fit_boosted
from sparktab.operators.calibration import SigmoidCalibration, fit_sigmoid, held_out_margins
from sparktab.operators.features import _Stage
from sparktab.operators.kernel_svm import fit_kernel_svm
from sparktab.operators.networks import fit_network
from sparktab.operators.prep import ROW_ID
from sparktab.session import checkpoint_root, cut_lineage, drop_finished_shuffles, release, remove, scratch_path

# Default parameters of each algorithm.
DEFAULTS: dict[str, dict] = {
    "svm": {"C": 1.0, "gamma": "scale", "kernel": "rbf", "probability": True, "random_state": 42},
    "random_forest": {
        "n_estimators": 200,
        "max_depth": 8,
        "min_samples_split": 2,
        "random_state": 42,
        "n_jobs": -1,
    },
    "adaboost": {"n_estimators": 200, "learning_rate": 0.5, "random_state": 42},
    "xgboost": {
        "n_estimators": 200,
        "max_depth": 6,
        "learning_rate": 0.1,
        "subsample": 0.9,
        "colsample_bytree": 0.9,
        "objective": "binary:logistic",
        "eval_metric": "logloss",
        "random_state": 42,
        "n_jobs": -1,
    },
    "knn": {"n_neighbors": 5, "weights": "uniform"},
    "logistic_regression": {"C": 1.0, "max_iter": 300, "solver": "lbfgs"},
    "neural_network": {
        "hidden_layer_sizes": (64, 32),
        "learning_rate_init": 0.001,
        "max_iter": 400,
        "early_stopping": True,
        "random_state": 42,
    },
}
#: What the algorithm itself takes for granted about parameters that are not listed above.
BOOSTING = {"reg_lambda": 1.0, "gamma": 0.0, "min_child_weight": 1.0, "base_score": 0.5, "max_bins": MAX_BINS}
EXTRA_PARAMETERS = {"svm": {"n_fourier"}, "adaboost": {"max_bins"}, "random_forest": {"max_bins"}, "xgboost": set(BOOSTING)}
SPARK_MAX_DEPTH = 30
CHECKPOINT_ROUNDS = 10
#: Trees fitted together hold a count per row and tree: this many counts at most, unless LEAST_TREES need more.
FOREST_COUNTS, LEAST_TREES = 1 << 29, 10
#: Deeper trees keep the node of every row and tree instead of finding it again from the root.
SHALLOW = 12
STUMP_BINS = 250
#: Parts into which the bins that may hold a better cut are cut in one pass.
STUMP_PARTS = 1 << 14
STUMP_BLOCK = "x binary, bins binary, label binary, log_weight binary"


def resolve_parameters(algorithm: str, params: dict | None = None) -> dict:
    """Defaults overlaid by the caller's values; unknown names raise."""
    name = algorithm_name(algorithm)
    params = params or {}
    unknown = set(params) - set(DEFAULTS[name]) - EXTRA_PARAMETERS.get(name, set())
    if unknown:
        raise ValueError(f"Unknown parameters for {name}: {sorted(unknown)}")
    return {**DEFAULTS[name], **params}


def fit_classifier(
    algorithm: str, df: DataFrame, n_classes: int, params: dict | None = None, row_id: str = ROW_ID
) -> list:
    """Fitted stages for an encoded table with ``n_classes`` classes."""
    name = algorithm_name(algorithm)
    p = resolve_parameters(name, params)
    checkpoint_root(df.sparkSession)
    if name == "random_forest":
        return [fit_forest(df, p)]
    if name == "logistic_regression":
        return [_logistic(p, df.count()).fit(df)]
    if name == "neural_network":
        return [fit_network(df, _width(df), n_classes, p, row_id)]
    if name == "adaboost":
        return [fit_adaboost(df, n_classes, p["n_estimators"], p["learning_rate"], p.get("max_bins", STUMP_BINS))]
    if name == "knn":
        return [fit_knn(df, n_classes, p["n_neighbors"], p["weights"], row_id)]
    fit_two = (lambda part: [fit_boosted(part, {**BOOSTING, **p}, _width(df), row_id)]) if name == "xgboost" else (lambda part: _fit_svm(part, p, row_id))
    if n_classes == 2:
        return fit_two(df)
    return [fit_one_vs_rest(df, n_classes, fit_two)]


def _width(df: DataFrame) -> int:
    meta = df.schema["features"].metadata.get("ml_attr", {})
    return meta["num_attrs"] if "num_attrs" in meta else df.select("features").first()[0].size


def tree_depth(max_depth: int | None) -> int:
    """None grows trees to the deepest level Spark has; an explicit deeper one is an error, not a cut."""
    if max_depth is not None and max_depth > SPARK_MAX_DEPTH:
        raise ValueError(f"max_depth is at most {SPARK_MAX_DEPTH}: {max_depth}")
    return SPARK_MAX_DEPTH if max_depth is None else max_depth


def _random_forest(p: dict) -> RandomForestClassifier:
    depth = tree_depth(p["max_depth"])
    return RandomForestClassifier(
        numTrees=p["n_estimators"],
        maxDepth=depth,
        minInstancesPerNode=max(1, p["min_samples_split"] // 2),
        featureSubsetStrategy="sqrt",
        maxBins=p.get("max_bins", 32),
        cacheNodeIds=depth > SHALLOW,
        checkpointInterval=CHECKPOINT_ROUNDS,
        seed=p["random_state"],
    )


def forest_groups(n_trees: int, rows: int) -> list[int]:
    """Trees of each group that is fitted together, even in size and few enough for the rows."""
    most = max(LEAST_TREES, FOREST_COUNTS // max(1, rows))
    n = max(1, math.ceil(n_trees / most))
    return [n_trees // n + (i < n_trees % n) for i in range(n)]


def fit_forest(df: DataFrame, p: dict):
    """All trees of the forest. Spark keeps a count per row and tree while it fits, so many trees over many rows are
    fitted in groups, each with a seed of its own, that vote together."""
    sizes = forest_groups(p["n_estimators"], df.count())
    # seeds far apart, lest a group repeat seeds of another
    parts = [
        _random_forest({**p, "n_estimators": n, "random_state": p["random_state"] + i * 1_000_003}).fit(df)
        for i, n in enumerate(sizes)
    ]
    return parts[0] if len(parts) == 1 else ForestGroups(parts)


def _logistic(p: dict, n: int) -> LogisticRegression:
    """The penalty C weighs the loss sum; Spark weighs the mean, hence 1 / (C n)."""
    return LogisticRegression(
        regParam=1.0 / (p["C"] * n), elasticNetParam=0.0, standardization=False, maxIter=p["max_iter"]
    )


class RandomFourierFeatures(_Stage, Transformer):
    """Approximates an RBF kernel: sqrt(2/D) cos(Wx + b), W ~ N(0, 2 gamma).

    W and b are regenerated from the seed inside each task.
    """

    width = Param(Params._dummy(), "width", "input features")
    size = Param(Params._dummy(), "size", "output features")
    gamma = Param(Params._dummy(), "gamma", "kernel width")
    seed = Param(Params._dummy(), "seed", "random seed")

    @keyword_only
    def __init__(self, width=None, size=None, gamma=None, seed=None):
        super().__init__()
        self._fill(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        width, size, gamma, seed = (self.value(n) for n in ("width", "size", "gamma", "seed"))

        @F.pandas_udf("array<double>")
        def lift(vectors: pd.Series) -> pd.Series:
            rng = np.random.default_rng(seed)
            w = rng.normal(0.0, math.sqrt(2.0 * gamma), (width, size))
            b = rng.uniform(0.0, 2.0 * math.pi, size)
            if vectors.empty:
                return pd.Series([], dtype=object)
            x = np.stack(vectors.to_numpy())
            return pd.Series(list(math.sqrt(2.0 / size) * np.cos(x @ w + b)))

        return df.withColumn("fourier", array_to_vector(lift(vector_to_array("features"))))


def _kernel_width(df: DataFrame, gamma) -> float:
    """'scale' is 1 / (width * variance of all entries), 'auto' 1 / width."""
    if gamma not in ("scale", "auto"):
        return float(gamma)
    width = _width(df)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        Summarizer.metrics("mean", "variance").summary(F.col("features")).alias("s"),
    ).first()
    n = row["n"]
    mean = row["s"]["mean"].toArray()
    var = row["s"]["variance"].toArray() * (n - 1) / n
    spread = float((var + mean * mean).mean() - mean.mean() ** 2)
    return 1.0 / width if gamma == "auto" or spread == 0 else 1.0 / (width * spread)


def _fit_svm(df: DataFrame, p: dict, row_id: str) -> list:
    """Support vectors of the RBF kernel, or a linear SVM, the latter also on random
    Fourier features where ``n_fourier`` asks for them; probabilities are a sigmoid fitted
    to margins of rows that their model has not seen."""
    if p["kernel"] not in ("rbf", "linear"):
        raise ValueError(f"Unknown kernel: {p['kernel']}")
    stages: list = []
    source = "features"
    width = _width(df)
    gamma = _kernel_width(df, p["gamma"]) if p["kernel"] == "rbf" else None
    if gamma is not None and p.get("n_fourier"):
        stages.append(RandomFourierFeatures(width=width, size=p["n_fourier"], gamma=gamma, seed=p["random_state"]))
        df, source = stages[0].transform(df), "fourier"

    def fit_margin(train: DataFrame):
        if gamma is not None and not stages:
            return fit_kernel_svm(train, width, p["C"], gamma)
        return LinearSVC(
            featuresCol=source,
            rawPredictionCol="margins",
            regParam=1.0 / (p["C"] * train.count()),
            standardization=False,
            maxIter=100,
            tol=1e-3,
        ).fit(train)

    def margin_of(train: DataFrame):
        fitted = fit_margin(train)
        return lambda rows: fitted.transform(rows).withColumn("margin", vector_to_array("margins")[1])

    svc = fit_margin(df)
    slope, offset = fit_sigmoid(cut_lineage(held_out_margins(df, margin_of, row_id, p["random_state"])))
    return [*stages, svc, SigmoidCalibration(slope=slope, offset=offset)]


class _DirectoryWriter(DefaultParamsWriter):
    """Parameters plus whatever the stage keeps next to them."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance._save_parts(path)


class _PartsStage(_Stage, MLWritable):
    def write(self):
        return _DirectoryWriter(self)


class OneVsRestProbability(_PartsStage, Model):
    """One two-class model per class; positive shares normalised to sum 1."""

    size = Param(Params._dummy(), "size", "number of classes")

    @keyword_only
    def __init__(self, size=None):
        super().__init__()
        self.parts: list[PipelineModel] = []
        self._fill(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        shares = []
        for i, part in enumerate(self.parts):
            share = f"_share{i}"
            df = part.transform(df).withColumn(share, vector_to_array("probability")[1])
            shares.append(share)
            df = df.select(*keep, *shares)
        total = sum((F.col(s) for s in shares[1:]), F.col(shares[0]))
        even = F.lit(1.0 / len(shares))
        normal = F.array(*[F.when(total > 0, F.col(s) / total).otherwise(even) for s in shares])
        best = F.array_position("_p", F.array_max("_p")) - 1
        return (
            df.withColumn("_p", normal)
            .withColumn("prediction", best.cast("double"))
            .withColumn("probability", array_to_vector("_p"))
            .drop("_p", *shares)
        )

    def _save_parts(self, path: str) -> None:
        for i, part in enumerate(self.parts):
            part.write().save(f"{path}/class_{i}")

    @classmethod
    def read(cls):
        return _OneVsRestReader(cls)


class ForestGroups(_PartsStage, Model):
    """One forest whose trees were fitted in groups; every tree has the same vote."""

    size = Param(Params._dummy(), "size", "number of groups")

    def __init__(self, parts: list[RandomForestClassificationModel] | None = None):
        super().__init__()
        self.parts = parts or []

    @property
    def featureImportances(self) -> DenseVector:
        """Mean of the importances of all trees that have a split, as in a forest fitted at once."""
        total = 0.0
        for part in self.parts:
            total = total + part.featureImportances.toArray() * sum(t.numNodes > 1 for t in part.trees)
        return DenseVector(total / total.sum() if total.sum() else total)

    @property
    def getNumTrees(self) -> int:
        return sum(part.getNumTrees for part in self.parts)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = []
        for i, part in enumerate(self.parts):
            names.append(f"_votes{i}")
            own = part.copy().setRawPredictionCol(names[-1]).setProbabilityCol("").setPredictionCol("")
            df = own.transform(df)
        votes = [vector_to_array(n) for n in names]
        sums = F.array(*[sum((v[c] for v in votes[1:]), votes[0][c]) for c in range(self.parts[0].numClasses)])
        mass = sum(part.getNumTrees for part in self.parts)
        best = F.array_position("_sums", F.array_max("_sums")) - 1
        return (
            df.withColumn("_sums", sums)
            .withColumn("prediction", best.cast("double"))
            .withColumn("rawPrediction", array_to_vector("_sums"))
            .withColumn("probability", array_to_vector(F.transform("_sums", lambda v: v / mass)))
            .drop("_sums", *names)
        )

    def _save_parts(self, path: str) -> None:
        for i, part in enumerate(self.parts):
            part.write().save(f"{path}/group_{i}")

    def write(self):
        self._fill(size=len(self.parts))
        return super().write()

    @classmethod
    def read(cls):
        return _ForestReader(cls)


class _ForestReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model.parts = [RandomForestClassificationModel.load(f"{path}/group_{i}") for i in range(model.value("size"))]
        return model


class _OneVsRestReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model.parts = [PipelineModel.load(f"{path}/class_{i}") for i in range(model.value("size"))]
        return model


def fit_one_vs_rest(df: DataFrame, n_classes: int, fit_two) -> OneVsRestProbability:
    model = OneVsRestProbability(size=n_classes)
    for k in range(n_classes):
        part = df.withColumn("label", (F.col("label") == k).cast("double"))
        model.parts.append(PipelineModel(fit_two(part)))
    return model


class BoostedStumps(_Stage, Model):
    """Weighted vote of depth-1 trees, evaluated as one SQL expression."""

    stumps = Param(Params._dummy(), "stumps", "[feature, threshold, left, right, weight]")
    size = Param(Params._dummy(), "size", "number of classes")

    @keyword_only
    def __init__(self, stumps=None, size=None):
        super().__init__()
        self._fill(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        k = self.value("size")
        stumps = self.value("stumps")
        total = sum(s[4] for s in stumps)
        df = df.withColumn("_x", vector_to_array("features"))
        table = F.array(
            *[
                F.struct(
                    F.lit(int(f)).alias("f"),
                    F.lit(float(t)).alias("t"),
                    F.lit(float(left)).alias("l"),
                    F.lit(float(right)).alias("r"),
                    F.lit(float(w)).alias("w"),
                )
                for f, t, left, right, w in stumps
            ]
        )
        zero = F.array(*[F.lit(0.0)] * k)
        classes = F.array(*[F.lit(float(c)) for c in range(k)])

        def add(votes: Column, s: Column) -> Column:
            chosen = F.when(F.element_at("_x", s["f"] + 1) <= s["t"], s["l"]).otherwise(s["r"])
            return F.zip_with(
                votes, classes, lambda v, c: v + F.when(chosen == c, s["w"]).otherwise(-s["w"] / (k - 1))
            )

        decision = F.transform(F.aggregate(table, zero, add), lambda v: v / total)
        # Two classes: softmax of (-d/2, d/2), d = difference of both votes; else votes/(k-1).
        scaled = F.transform("_d", lambda v: v if k == 2 else v / (k - 1))
        top = F.array_max("_s")
        powers = F.transform("_s", lambda v: F.exp(v - top))
        mass = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
        return (
            df.withColumn("_d", decision)
            .withColumn("_s", scaled)
            .withColumn("_e", powers)
            .withColumn(
                "prediction", (F.array_position("_d", F.array_max("_d")) - 1).cast("double")
            )
            .withColumn("probability", array_to_vector(F.transform("_e", lambda x: x / mass)))
            .drop("_x", "_d", "_s", "_e")
        )


def fit_adaboost(df: DataFrame, n_classes: int, rounds: int, rate: float, bins: int = STUMP_BINS) -> BoostedStumps:
    """SAMME over depth-1 trees that are cut at any value.

    Features are cut into bins once and rows are packed into blocks. A round sums the
    weights per (feature, bin, class), which gives the impurity of cuts between bins and
    a bound on that of cuts inside one; only bins that may hold a better cut are cut again
    into parts, until no part can hold one. The number of bins changes the work, never the
    result. The blocks stay in memory as arrays, since a fit is many short jobs. The first
    pass of a round adds the stump before to the log weights, which are checkpointed every
    few rounds.
    """
    cuts = _quantile_cuts(df, bins)
    blocks = cut_lineage(_stump_blocks(df, cuts))
    ends, n = _bin_ends(blocks, cuts)
    data, older = _opened_stumps(blocks, len(cuts), _bin_kind(cuts)).persist(StorageLevel.MEMORY_AND_DISK), None
    stored: list[str] = []
    stumps: list[list] = []
    shift = 0.0
    for i in range(rounds):
        best = _best_split(data, shift, n_classes, ends)
        if older is not None:
            older.unpersist()
            older = None
        if data.isCheckpointed():
            # what the weights before were read from is not needed any more
            stored.append(data.getCheckpointFile())
            remove(df.sparkSession, *stored[:-1])
            drop_finished_shuffles(df.sparkSession)
            del stored[:-1]
        if best is None:
            break
        f, threshold, left_mass, right_mass = best
        left, right = float(np.argmax(left_mass)), float(np.argmax(right_mass))
        total = left_mass.sum() + right_mass.sum()
        error = 1.0 - (left_mass[int(left)] + right_mass[int(right)]) / total
        stump = [f, threshold, left, right]
        if error <= 1e-15:
            stumps.append([*stump, 1.0])
            break
        if error >= 1 - 1 / n_classes:
            break
        power = rate * (math.log((1 - error) / error) + math.log(n_classes - 1))
        stumps.append([*stump, power])
        # Keep the weights near 1: their new sum is known without another pass.
        shift += math.log(total * (1 - error + error * math.exp(power)) / n)
        older, data = data, _with_log_weights(data, stumps[-1]).persist(StorageLevel.MEMORY_AND_DISK)
        if len(stumps) % CHECKPOINT_ROUNDS == 0:
            data.checkpoint()
    for kept in (data, older):
        if kept is not None:
            kept.unpersist()
    remove(df.sparkSession, *stored)
    release(blocks)
    if not stumps:
        raise ValueError("AdaBoost: no stump is better than chance.")
    return BoostedStumps(stumps=stumps, size=n_classes)


def _stump_blocks(df: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """One row for each Arrow batch: values and bins (features x rows), class numbers and log weights of 0. A value lies in
    bin b if b borders are less. A row without a class has the number -1."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts)).T
            bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x)]).astype(_bin_kind(cuts))
            label = np.nan_to_num(batch.column("label").to_numpy(zero_copy_only=False), nan=-1.0).astype(np.int32)
            yield _stump_block(np.ascontiguousarray(x), bins, label, np.zeros(len(label)))

    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    return rows.where("x IS NOT NULL").mapInArrow(run, STUMP_BLOCK)


def _bin_kind(cuts: list[list[float]]) -> type:
    return np.uint8 if max(map(len, cuts), default=0) < 256 else np.int32


def _stump_block(*columns: np.ndarray) -> pa.RecordBatch:
    names = [c.split()[0] for c in STUMP_BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names)


def _stump_arrays(row, width: int, kind: type) -> tuple:
    """(values, bins, class numbers, log weights) of a block."""
    x, bins = np.frombuffer(row["x"]).reshape(width, -1), np.frombuffer(row["bins"], kind).reshape(width, -1)
    return x, bins, np.frombuffer(row["label"], np.int32), np.frombuffer(row["log_weight"])


def _opened_stumps(blocks: DataFrame, width: int, kind: type) -> RDD:
    return blocks.rdd.map(lambda row: _stump_arrays(row, width, kind))


def _with_log_weights(data: RDD, stump: list) -> RDD:
    """The blocks with a stump added to their log weights."""
    f, t, left, right, power = stump

    def add(block):
        x, bins, label, w = block
        return x, bins, label, w + power * (np.where(x[f] <= t, left, right) != label)

    return data.map(add)


def _bin_ends(data: DataFrame, cuts: list[list[float]]) -> tuple[dict[int, list], int]:
    """The bins (number, least value, greatest value) that hold rows, ascending for each feature, and the number of rows."""

    def run(batches):
        sizes = [len(c) + 1 for c in cuts]
        low, high, n = [np.full(k, np.nan) for k in sizes], [np.full(k, -np.inf) for k in sizes], [np.zeros(k, np.int64) for k in sizes]
        for x, bins, *_ in (_stump_arrays(row, len(cuts), _bin_kind(cuts)) for batch in batches for row in batch.to_pylist()):
            for f, k in enumerate(sizes):
                np.fmin.at(low[f], bins[f], x[f])
                np.maximum.at(high[f], bins[f], x[f])
                n[f] += np.bincount(bins[f], minlength=k)
        for f in range(len(sizes)):
            b = np.flatnonzero(n[f])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), f, np.int32)), pa.array(b.astype(np.int32)), *[pa.array(v[f][b]) for v in (low, high, n)]], names)

    names = ["f", "b", "low", "high", "n"]
    cells = data.mapInArrow(run, "f int, b int, low double, high double, n bigint").groupBy("f", "b")
    # at most features x bins rows
    rows = sorted(cells.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect(), key=lambda r: (r["f"], r["b"]))
    ends: dict[int, list] = {}
    for row in rows:
        ends.setdefault(row["f"], []).append((row["b"], row["low"], row["high"]))
    return ends, sum(row["n"] for row in rows if row["f"] == 0)


def _quantile_cuts(df: DataFrame, bins: int) -> list[list[float]]:
    """Ascending bin borders of every feature, from one sketch pass."""
    width = _width(df)
    shares = [i / bins for i in range(1, bins)]
    x = vector_to_array("features")
    row = df.select(x.alias("x")).agg(
        *[
            F.array_append(
                F.percentile_approx(F.col("x")[j], shares, 100 * bins), F.min(F.col("x")[j])
            ).alias(f"q{j}")
            for j in range(width)
        ]
    ).first()
    return [sorted(set(row[f"q{j}"])) for j in range(width)]


def _impurity(mass: np.ndarray) -> np.ndarray:
    """Weighted Gini impurity of class masses (last axis)."""
    total = mass.sum(axis=-1)
    return np.where(total > 0, total - (mass * mass).sum(axis=-1) / np.where(total > 0, total, 1.0), 0.0)


def _best_split(data: RDD, shift: float, n_classes: int, ends: dict[int, list]):
    """(feature, threshold, left masses, right masses) of the cut x <= threshold with the least Gini impurity; of equal
    ones the first feature's least. None if no feature has two values."""
    masses = _bin_masses(data, shift, n_classes, ends)
    best, inside = None, []
    for f, listed in ends.items():
        bins, low, high = (np.array(column) for column in zip(*listed))
        mass = masses[f][bins]
        best, found = _judged(best, f, low, high, mass, np.zeros(n_classes), mass.sum(axis=0))
        inside += found
    # impurity is concave in the masses left of the cut: inside a bin it is least at a corner
    while wanted := [c for c in inside if best is None or c[0] < best[0]]:
        inside = []
        for (_, f, _, _, before, whole), parts in zip(wanted, _part_masses(data, shift, n_classes, wanted)):
            best, found = _judged(best, f, *parts, before, whole)
            inside += found
    return best and best[1:]


def _judged(best, f: int, low: np.ndarray, high: np.ndarray, mass: np.ndarray, before: np.ndarray, whole: np.ndarray) -> tuple:
    """The better of ``best`` and the cuts between neighbouring ranges (least, greatest value, masses) of a feature, and the
    ranges that may hold cuts: (bound, feature, least, greatest value, masses before, all masses)."""
    upto = before + np.cumsum(mass, axis=0)
    if len(low) > 1:
        impurity = _cut_impurity(upto[:-1], whole)
        i = int(np.argmax(impurity <= impurity.min() * (1 + 1e-12)))
        best = _better(best, (float(impurity[i]), f, float(high[i]), upto[i], whole - upto[i]))
    open_ones = np.flatnonzero(low < high)
    bounds = _least_inside(upto[open_ones] - mass[open_ones], mass[open_ones], whole)
    return best, [(float(bound), f, float(low[i]), float(high[i]), upto[i] - mass[i], whole) for i, bound in zip(open_ones, bounds)]


def _bin_masses(data: RDD, shift: float, n_classes: int, ends: dict[int, list]) -> list[np.ndarray]:
    """Weights of each class in every bin of every feature: one pass; a task gives the driver features x bins x classes."""
    sizes = [1 + max(b for b, *_ in ends[f]) for f in ends]

    def run(blocks):
        sums = [np.zeros(k * n_classes) for k in sizes]
        for _, bins, label, w in blocks:
            weight, own = _class_weights(label, w, shift, n_classes)
            for f, k in enumerate(sizes):
                sums[f] += np.bincount(bins[f].astype(np.int64) * n_classes + own, weight, k * n_classes)
        yield np.concatenate(sums)

    total = _summed(data.mapPartitions(run), sum(sizes) * n_classes)
    return [part.reshape(-1, n_classes) for part in np.split(total, np.cumsum(sizes)[:-1] * n_classes)]


def _class_weights(label: np.ndarray, w: np.ndarray, shift: float, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights, 0 for rows without one of the classes, and class numbers."""
    return np.where((label >= 0) & (label < n_classes), np.exp(w - shift), 0.0), np.clip(label, 0, n_classes - 1)


def _summed(parts: RDD, size: int) -> np.ndarray:
    """Sum of one vector a task, by the driver if they are few bytes, else by tasks first."""
    if parts.getNumPartitions() * size * 8 <= DRIVER_BYTES:
        return sum(parts.collect(), np.zeros(size))
    return parts.treeReduce(np.add)


def _better(old, new):
    """The tuple (impurity, feature, threshold, ...) that comes first; impurities equal up to rounding are equal."""
    if old is None or new is None:
        return old or new
    if abs(new[0] - old[0]) <= 1e-12 * max(new[0], old[0]):
        return min(old, new, key=lambda c: c[1:3])
    return min(old, new, key=lambda c: c[0])


def _cut_impurity(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return _impurity(left) + _impurity(np.maximum(whole - left, 0.0))


def _least_inside(before: np.ndarray, mass: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For each range: no cut inside it has less impurity."""
    n_classes = mass.shape[1]
    if n_classes > 8:
        return np.full(len(mass), -np.inf)
    corners = (np.arange(1 << n_classes)[:, None, None] >> np.arange(n_classes)) & 1
    return _cut_impurity(before + corners * mass, whole).min(axis=0) * (1 - 1e-9)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values, different for different values."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def _part_masses(data: RDD, shift: float, n_classes: int, ranges: list[tuple]) -> list[tuple]:
    """For each (bound, feature, least, greatest value, ...), ascending in a feature, the parts that hold rows: least values,
    greatest values and masses. A part holds one value at last, since each pass cuts a range into at least two parts that
    hold rows."""
    n_parts = max(2, STUMP_PARTS // len(ranges))
    places = {}
    for f in {r[1] for r in ranges}:
        own = [k for k, r in enumerate(ranges) if r[1] == f]
        low, high = (np.array([ranges[k][side] for k in own]) for side in (2, 3))
        first = _ordered(low)
        places[f] = np.array(own), low, high, first, (_ordered(high) - first) // np.uint64(n_parts) + np.uint64(1)
    size = len(ranges) * n_parts

    def run(blocks):
        low, high, sums = np.full(size, np.inf), np.full(size, -np.inf), np.zeros(size * n_classes)
        for x, _, label, w in blocks:
            weight, own = _class_weights(label, w, shift, n_classes)
            for f, (ks, least, greatest, first, step) in places.items():
                at = np.searchsorted(greatest, x[f], "left")
                rows = np.flatnonzero((at < len(ks)) & (x[f] >= least[np.minimum(at, len(ks) - 1)]))
                at, v = at[rows], x[f][rows]
                at = ks[at] * n_parts + ((_ordered(v) - first[at]) // step[at]).astype(np.int64)
                np.minimum.at(low, at, v)
                np.maximum.at(high, at, v)
                sums += np.bincount(at * n_classes + own[rows], weight[rows], size * n_classes)
        yield low, high, sums

    # STUMP_PARTS parts at most (or two for each range), whatever the table's size
    merge = lambda a, b: (np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), a[2] + b[2])
    told = data.mapPartitions(run)
    if told.getNumPartitions() * size * (n_classes + 2) * 8 <= DRIVER_BYTES:
        low, high, sums = functools.reduce(merge, told.collect())
    else:
        low, high, sums = told.treeReduce(merge)
    low, high, sums = low.reshape(-1, n_parts), high.reshape(-1, n_parts), sums.reshape(-1, n_parts, n_classes)
    filled = low <= high
    return [(low[k][own], high[k][own], sums[k][own]) for k, own in enumerate(filled)]


class NearestNeighbourModel(_PartsStage, Model):
    """Votes of the k nearest training rows, which are kept as a stored cell index."""

    path = Param(Params._dummy(), "path", "cell index of the training table")
    k = Param(Params._dummy(), "k", "neighbours")
    weights = Param(Params._dummy(), "weights", "uniform or distance")
    size = Param(Params._dummy(), "size", "number of classes")
    rowId = Param(Params._dummy(), "rowId", "unique id of scored rows")

    @keyword_only
    def __init__(self, path=None, k=None, weights=None, size=None, rowId=None):
        super().__init__()
        self._fill(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        row_id = self.value("rowId")
        own_id = row_id in df.columns
        if not own_id:
            df = cut_lineage(df.withColumn(row_id, F.monotonically_increasing_id()))
        index = knn.CellIndex.load(df.sparkSession, self.value("path"))
        queries = df.select(F.col(row_id).alias("qid"), vector_to_array("features").alias("vec"))
        found = knn.search(queries, index, self.value("k"))
        votes = knn.vote(found, self.value("size"), self.value("weights"))
        out = df.join(votes.withColumnRenamed("qid", row_id), row_id).withColumn(
            "probability", array_to_vector("probability")
        )
        return out if own_id else out.drop(row_id)

    def _save_parts(self, path: str) -> None:
        spark = SparkSession.active()
        for part in ("rows", "cells"):
            spark.read.parquet(f"{self.value('path')}/{part}").write.parquet(f"{path}/index/{part}")

    @classmethod
    def read(cls):
        return _NeighbourReader(cls)


class _NeighbourReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model._fill(path=f"{path}/index")
        return model


def fit_knn(df: DataFrame, n_classes: int, k: int, weights: str, row_id: str):
    if weights not in ("uniform", "distance"):
        raise ValueError(f"Unknown weights: {weights}")
    path = scratch_path(df.sparkSession, "neighbours")
    train = df.select(F.col(row_id).alias("tid"), "label", vector_to_array("features").alias("vec"))
    knn.build_index(train).save(path)
    return NearestNeighbourModel(path=path, k=k, weights=weights, size=n_classes, rowId=row_id)
