"""A feed-forward network: ReLU layers, softmax, Adam, a held-back tenth and early stopping.

Rows are packed into blocks, which are dealt to many small partitions and stay in memory
as arrays. An epoch deals the partitions anew into batches of the same number of
partitions. A batch is one job over its partitions only: every task adds up the gradients
of its blocks, and the driver sums the tasks, whose number is bounded by the bytes of a
gradient, and makes the Adam step. Weights are a few kilobytes to megabytes (their number
follows from the layers), rows never leave the tasks.

After each epoch the accuracy on the held-back rows is one more job. Training stops when
it has not risen by TOLERANCE for PATIENCE epochs; the weights of the best epoch stay.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.operators.features import _Stage
from sparktab.session import cut_lineage, release

HELD_BACK = 0.1
PATIENCE, TOLERANCE = 10, 1e-4
PENALTY = 1e-4
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8
#: Batches of an epoch, rows of a batch at least.
BATCHES, LEAST_ROWS = 24, 200
#: Tasks of a batch: as many as the session's shuffles have and rows ask for, while their gradients are few bytes, and 16 else.
TASK_ROWS, DRIVER_BYTES, LEAST_TASKS = 1 << 17, 1 << 25, 16

Weights = list[tuple[np.ndarray, np.ndarray]]


def start(sizes: list[int], seed: int) -> Weights:
    """Uniform weights within sqrt(6 / (in + out))."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = math.sqrt(6 / (a + b))
        out.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
    return out


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for pair in weights for x in pair])


def shaped(vector: np.ndarray, sizes: list[int]) -> Weights:
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append((vector[at : at + a * b].reshape(a, b), vector[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    """The input, the output of each hidden layer, and the class shares."""
    layers = [x]
    for w, b in weights[:-1]:
        layers.append(np.maximum(layers[-1] @ w + b, 0))
    z = layers[-1] @ weights[-1][0] + weights[-1][1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return [*layers, z / z.sum(axis=1, keepdims=True)]


def gradient(weights: Weights, x: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over rows of the log loss and of its gradient."""
    layers = forward(weights, x)
    shares = layers.pop()
    rows = np.arange(len(x))
    loss = -np.log(np.maximum(shares[rows, label], 1e-300)).sum()
    delta = shares.copy()
    delta[rows, label] -= 1
    grads = []
    for (w, _), below in zip(reversed(weights), reversed(layers)):
        grads.append((below.T @ delta, delta.sum(axis=0)))
        delta = (delta @ w.T) * (below > 0)
    return float(loss), flat(grads[::-1])


def packed(df: DataFrame, width: int, row_id: str, seed: int, block_rows: int) -> DataFrame:
    """(block, held, n, x, label): rows in blocks, training rows and held-back ones apart."""
    held = F.pmod(F.xxhash64(F.lit(int(seed)), row_id), F.lit(10_000)) < int(HELD_BACK * 10_000)

    def run(batches):
        for batch in batches:
            side = batch.column("held").to_numpy(zero_copy_only=False)
            for which in (False, True):
                own = batch.filter(pa.array(side == which))
                for low in range(0, own.num_rows, block_rows):
                    some = own.slice(low, block_rows)
                    x = some.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    label = some.column("label").to_numpy(zero_copy_only=False).astype(np.int32)
                    columns = [[which], [some.num_rows], [x.tobytes()], [label.tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["held", "n", "x", "label"])

    rows = df.select(vector_to_array("features").alias("x"), "label", held.alias("held"))
    return rows.mapInArrow(run, "held boolean, n long, x binary, label binary").withColumn("block", F.monotonically_increasing_id())


def opened(blocks: DataFrame) -> RDD:
    """(features, class numbers) of each block."""

    def arrays(row):
        label = np.frombuffer(row["label"], np.int32)
        return np.frombuffer(row["x"]).reshape(len(label), -1), label

    return blocks.select("x", "label").rdd.map(arrays)


def summed(blocks: DataFrame | RDD, weights: Weights, sizes: list[int], with_gradient: bool, partitions: list[int] | None = None) -> tuple[int, float, np.ndarray]:
    """Rows, loss (or right predictions) and gradient over all blocks, or over those of some partitions."""
    rows = opened(blocks) if isinstance(blocks, DataFrame) else blocks
    size = 2 + (len(flat(weights)) if with_gradient else 0)

    def own(some):
        total = np.zeros(size)
        for x, label in some:
            if with_gradient:
                loss, grad = gradient(weights, x, label)
                total += np.concatenate([[len(x), loss], grad])
            else:
                total += [len(x), (forward(weights, x)[-1].argmax(axis=1) == label).sum()]
        return [total]

    total = sum(rows.context.runJob(rows, own, partitions), np.zeros(size))
    return int(total[0]), float(total[1]), total[2:]


def tasks_of_batch(rows: int, weights: int, most: int) -> int:
    """Tasks for a batch of so many rows and a network of so many weights."""
    wanted = max(LEAST_TASKS, math.ceil(rows / TASK_ROWS))
    return max(1, min(most, wanted, max(LEAST_TASKS, DRIVER_BYTES // (8 * weights))))


def fit_network(df: DataFrame, width: int, n_classes: int, p: dict, row_id: str) -> ReluNetwork:
    """p: hidden_layer_sizes, learning_rate_init, max_iter (epochs), early_stopping, random_state."""
    sizes = [width, *p["hidden_layer_sizes"], n_classes]
    n = df.count()
    batches = max(1, min(BATCHES, n // LEAST_ROWS))
    vector = flat(start(sizes, p["random_state"]))
    tasks = tasks_of_batch(n // batches, len(vector), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_parts = batches * tasks
    blocks = cut_lineage(packed(df, width, row_id, p["random_state"], max(32, min(4096, n // (n_parts * 2) or 1))))
    held = opened(blocks.where("held").coalesce(LEAST_TASKS * 8)).persist(StorageLevel.MEMORY_AND_DISK)
    stops = p["early_stopping"] and not held.isEmpty()
    train = opened((blocks.where("not held") if stops else blocks).repartition(n_parts)).persist(StorageLevel.MEMORY_AND_DISK)
    # weights are penalised, offsets are not
    counted = flat([(np.ones((a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:])])
    first, second, step = np.zeros_like(vector), np.zeros_like(vector), 0
    best, best_vector, waited, epoch = -np.inf, vector, 0, 0
    for epoch in range(1, p["max_iter"] + 1):
        loss = rows = 0
        dealt = np.random.default_rng([p["random_state"], epoch]).permutation(n_parts)
        for own in np.split(dealt, batches):
            # small tables may leave a batch empty
            m, its_loss, grad = summed(train, shaped(vector, sizes), sizes, True, sorted(own.tolist()))
            if not m:
                continue
            grad = (grad + PENALTY * counted * vector) / m
            step += 1
            first = BETA1 * first + (1 - BETA1) * grad
            second = BETA2 * second + (1 - BETA2) * grad * grad
            rate = p["learning_rate_init"] * math.sqrt(1 - BETA2**step) / (1 - BETA1**step)
            vector = vector - rate * first / (np.sqrt(second) + TINY)
            loss, rows = loss + its_loss, rows + m
        if stops:
            m, right, _ = summed(held, shaped(vector, sizes), sizes, False)
            score = right / m
        else:
            score = -loss / rows
        waited = waited + 1 if score < best + TOLERANCE else 0
        if score > best:
            best, best_vector = score, vector
        if waited > PATIENCE:
            break
    for kept_rows in (train, held):
        kept_rows.unpersist()
    release(blocks)
    kept = best_vector if stops else vector
    return ReluNetwork(weights=kept.tolist(), sizes=sizes, epochs=epoch, best=float(best))


class ReluNetwork(_Stage, Model):
    """Class shares of a trained network; ``epochs`` tells when training stopped, ``best`` the best score on held-back rows."""

    weights = Param(Params._dummy(), "weights", "all weights and offsets, layer by layer")
    sizes = Param(Params._dummy(), "sizes", "units of each layer")
    epochs = Param(Params._dummy(), "epochs", "epochs trained")
    best = Param(Params._dummy(), "best", "best score")

    @keyword_only
    def __init__(self, weights=None, sizes=None, epochs=None, best=None):
        super().__init__()
        self._fill(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        vector, sizes = np.array(self.value("weights")), self.value("sizes")

        @F.pandas_udf("array<double>")
        def shares(features: pd.Series) -> pd.Series:
            if features.empty:
                return pd.Series([], dtype=object)
            return pd.Series(list(forward(shaped(vector, sizes), np.stack(features.to_numpy()))[-1]))

        best = F.array_position("_shares", F.array_max("_shares")) - 1
        return (
            df.withColumn("_shares", shares(vector_to_array("features")))
            .withColumn("probability", array_to_vector("_shares"))
            .withColumn("prediction", best.cast("double"))
            .drop("_shares")
        )
