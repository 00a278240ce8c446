"""Support vector machine with the RBF kernel, solved exactly in the dual by decomposition.

    min 1/2 a' Q a - sum a,   0 <= a_i <= C,   sum a_i y_i = 0,   Q_ij = y_i y_j exp(-gamma |x_i - x_j| ** 2)

Rows stay in blocks with their a_i and f_i = sum_j a_j y_j K(x_i, x_j). A round is one
job: every task adds what the last round's changes do to its f, and names its most
violating rows on both sides; Spark keeps the WORKING worst of all. The driver solves the
dual over those by sequential minimal optimisation, with the other a_i fixed, and sends
back the rows whose a_i changed. Rounds end when the worst pair violates the optimality
conditions by less than ``tolerance``. Driver and tasks hold WORKING rows and a kernel of
WORKING x WORKING entries, whatever the table's size.

The model is its support vectors, whose number may grow with the table. They are sent to
all tasks, so a model of more than SUPPORT_BYTES is an error, not a cut; the random
Fourier features of ``estimators`` are the way beyond.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktab.operators.features import _Stage
from sparktab.session import cut_lineage

WORKING, ACTIVE = 1024, 4096
TOLERANCE = 1e-3
#: Rounds between two checkpoints; kernel entries that a task holds at once; bytes of a model's vectors.
KEEP_ROUNDS, ENTRIES, SUPPORT_BYTES = 10, 1 << 22, 64 << 20
#: The driver solves its rows to this share of the tolerance.
CLOSER = 0.5
STATE = "block long, x binary, y binary, a binary, f binary"


def kernel(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1)[None, :] - 2 * (x @ z.T)
    return np.exp(-gamma * np.maximum(squares, 0.0))


def expansion(x: np.ndarray, z: np.ndarray, weights: np.ndarray, gamma: float) -> np.ndarray:
    """sum_j weights_j K(x_i, z_j) for every row of x, a slice at a time."""
    step = max(1, ENTRIES // max(1, len(z)))
    parts = [kernel(x[low : low + step], z, gamma) @ weights for low in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def sides(y: np.ndarray, a: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose a * y can rise, and rows whose a * y can fall."""
    return np.where(y > 0, a < c, a > 0), np.where(y > 0, a > 0, a < c)


def solve(k: np.ndarray, y: np.ndarray, a: np.ndarray, f: np.ndarray, c: float, tolerance: float, steps: int = 200_000) -> np.ndarray:
    """a after pairwise steps on the worst violating pairs, second-order choice of the partner."""
    a, f, diagonal = a.copy(), f.copy(), np.diag(k)
    for _ in range(steps):
        up, low = sides(y, a, c)
        v = y - f
        if not up.any() or not low.any():
            break
        i = int(np.argmax(np.where(up, v, -np.inf)))
        gap = v[i] - np.where(low, v, np.inf)
        if gap.max() <= tolerance:
            break
        curve = np.maximum(diagonal[i] + diagonal - 2 * k[i], 1e-12)
        j = int(np.argmax(np.where(low & (gap > 0), gap * gap / curve, -np.inf)))
        room_i = c - a[i] if y[i] > 0 else a[i]
        room_j = a[j] if y[j] > 0 else c - a[j]
        t = min(gap[j] / curve[j], room_i, room_j)
        a[i], a[j] = a[i] + y[i] * t, a[j] - y[j] * t
        for r, room in ((i, room_i), (j, room_j)):
            if t == room:  # exactly at its bound
                a[r] = 0.0 if a[r] < c / 2 else c
        f += t * (k[:, i] - k[:, j])
    return a


def _blocks(df: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                y = np.where(batch.column("label").to_numpy(zero_copy_only=False) > 0.5, 1.0, -1.0)
                zero = np.zeros(len(y)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (x.tobytes(), y.tobytes(), zero, zero)], ["x", "y", "a", "f"])

    rows = df.select(vector_to_array("features").alias("x"), "label").mapInArrow(run, "x binary, y binary, a binary, f binary")
    return rows.select(F.monotonically_increasing_id().alias("block"), "x", "y", "a", "f")


def _opened(batches, width: int):
    for batch in batches:
        for row in batch.to_pylist():
            y, a, f = (np.frombuffer(row[c]) for c in "yaf")
            yield row["block"], np.frombuffer(row["x"]).reshape(len(y), width), y, a, f


def _moved(state: DataFrame, change: dict, width: int, gamma: float) -> DataFrame:
    """The blocks after a change: rows z with the change of a * y, and the new a by (block, row)."""
    z, weights, new = change["z"], change["weights"], change["new"]

    def run(batches):
        for block, x, y, a, f in _opened(batches, width):
            a = a.copy()
            for row, value in new.get(block, ()):
                a[row] = value
            f = f + expansion(x, z, weights, gamma)
            columns = [pa.array([block])] + [pa.array([v.tobytes()], pa.binary()) for v in (x, y, a, f)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STATE.split(", ")])

    return state.mapInArrow(run, STATE)


def _worst(state: DataFrame, width: int, c: float, working: int) -> list:
    """The working / 2 worst rows of either side, with their vectors."""
    half = working // 2

    def run(batches):
        for block, x, y, a, f in _opened(batches, width):
            v = y - f
            for side, able in enumerate(sides(y, a, c)):
                score = v if side == 0 else -v
                at = np.flatnonzero(able)
                at = at[np.argsort(-score[at], kind="stable")[:half]]
                if len(at):
                    columns = [np.full(len(at), side), score[at], np.full(len(at), block), at, y[at], a[at], f[at]]
                    vectors = pa.array([r.tobytes() for r in x[at]], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[pa.array(k) for k in columns], vectors], names)

    names = ["side", "score", "block", "row", "y", "a", "f", "x"]
    rows = state.mapInArrow(run, "side long, score double, block long, row long, y double, a double, f double, x binary")
    order = Window.partitionBy("side").orderBy(F.desc("score"), "block", "row")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= half).orderBy("side", "r").collect()


class _Active:
    """Rows that the driver solves together: those with a > 0, the free ones first, up to a bound, and new violators."""

    def __init__(self, width: int):
        self.at: dict[tuple, int] = {}
        self.x, self.y, self.a, self.f = np.zeros((0, width)), np.zeros(0), np.zeros(0), np.zeros(0)

    def take(self, rows: list) -> None:
        """Adds rows of ``_worst`` and renews f of those that are here already."""
        for r in rows:
            if (r["block"], r["row"]) in self.at:
                self.f[self.at[r["block"], r["row"]]] = r["f"]
        new = list({(r["block"], r["row"]): r for r in rows if (r["block"], r["row"]) not in self.at}.items())
        self.at |= {key: len(self.y) + i for i, (key, _) in enumerate(new)}
        if new:
            self.x = np.concatenate([self.x, np.stack([np.frombuffer(r["x"]) for _, r in new])])
            self.y, self.a, self.f = (np.concatenate([old, [r[c] for _, r in new]]) for old, c in ((self.y, "y"), (self.a, "a"), (self.f, "f")))

    def solved(self, c: float, gamma: float, tolerance: float) -> dict | None:
        """Solves over the rows held; the change that all rows' f must take in, or None."""
        k = kernel(self.x, self.x, gamma)
        new = solve(k, self.y, self.a, self.f, c, tolerance)
        moved = np.flatnonzero(new != self.a)
        if not len(moved):
            return None
        weights = (new - self.a)[moved] * self.y[moved]
        self.f = self.f + k[:, moved] @ weights
        self.a = new
        keys = list(self.at)
        change = {"z": self.x[moved], "weights": weights, "new": {}}
        for i in moved:
            change["new"].setdefault(keys[i][0], []).append((keys[i][1], float(new[i])))
        return change

    def trim(self, c: float, most: int) -> None:
        keys = list(self.at)
        order = np.lexsort((np.arange(len(keys)), self.a >= c, self.a <= 0))
        kept = sorted(i for i in order[:most] if self.a[i] > 0)
        self.at = {keys[i]: n for n, i in enumerate(kept)}
        self.x, self.y, self.a, self.f = (v[kept] for v in (self.x, self.y, self.a, self.f))


def fit_kernel_svm(df: DataFrame, width: int, c: float, gamma: float, tolerance: float = TOLERANCE, working: int = WORKING, active: int = ACTIVE) -> SupportVectors:
    state = cut_lineage(_blocks(df)).persist()
    held, rounds = _Active(width), 0
    while True:
        rows = _worst(state, width, c, working)
        best = [max((r["score"] for r in rows if r["side"] == s), default=None) for s in (0, 1)]
        offset = 0.0 if None in best else (best[0] - best[1]) / 2
        if None in best or best[0] + best[1] <= tolerance:
            break
        held.take(rows)
        change = held.solved(c, gamma, tolerance * CLOSER)
        if change is None:
            break
        held.trim(c, active)
        rounds += 1
        old, state = state, _moved(state, change, width, gamma)
        if rounds % KEEP_ROUNDS == 0:
            state = cut_lineage(state)
        state = state.persist()
        state.count()
        old.unpersist()
    vectors, weights = _support(state, width)
    state.unpersist()
    model = SupportVectors(gamma=gamma, offset=offset, rounds=rounds)
    model.vectors, model.weights = vectors, weights
    return model


def _support(state: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        for _, x, y, a, _ in _opened(batches, width):
            at = np.flatnonzero(a > 0)
            if len(at):
                columns = [[len(at)], [x[at].tobytes()], [(a * y)[at].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["n", "x", "w"])

    rows = state.mapInArrow(run, "n long, x binary, w binary")
    n = rows.agg(F.sum("n")).first()[0] or 0
    if n * width * 8 > SUPPORT_BYTES:
        raise ValueError(f"{n} support vectors are too many for one model; set n_fourier to approximate the kernel.")
    found = rows.collect()
    x = np.frombuffer(b"".join(r["x"] for r in found)).reshape(-1, width)
    return x, np.frombuffer(b"".join(r["w"] for r in found))


class _VectorsWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        model = self.instance
        rows = [(i, model.vectors[i].tolist(), float(model.weights[i])) for i in range(len(model.weights))]
        SparkSession.active().createDataFrame(rows, "i long, x array<double>, w double").write.parquet(f"{path}/vectors")


class _VectorsReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        rows = SparkSession.active().read.parquet(f"{path}/vectors").orderBy("i").collect()
        model.vectors, model.weights = np.array([r["x"] for r in rows]), np.array([r["w"] for r in rows])
        return model


class SupportVectors(_Stage, Model, MLWritable):
    """Adds the margins of both classes and the prediction."""

    gamma = Param(Params._dummy(), "gamma", "kernel width")
    offset = Param(Params._dummy(), "offset", "constant of the decision function")
    rounds = Param(Params._dummy(), "rounds", "rounds of the decomposition")

    @keyword_only
    def __init__(self, gamma=None, offset=None, rounds=None):
        super().__init__()
        self.vectors, self.weights = np.zeros((0, 0)), np.zeros(0)
        self._fill(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, offset = self.value("gamma"), self.value("offset")
        sent = df.sparkSession.sparkContext.broadcast((self.vectors, self.weights))

        @F.pandas_udf("double")
        def margin(features: pd.Series) -> pd.Series:
            vectors, weights = sent.value
            if features.empty or not len(weights):
                return pd.Series(np.full(len(features), offset))
            return pd.Series(expansion(np.stack(features.to_numpy()), vectors, weights, gamma) + offset)

        return (
            df.withColumn("_margin", margin(vector_to_array("features")))
            .withColumn("margins", array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))))
            .withColumn("prediction", (F.col("_margin") > 0).cast("double"))
            .drop("_margin")
        )

    def write(self):
        return _VectorsWriter(self)

    @classmethod
    def read(cls):
        return _VectorsReader(cls)
