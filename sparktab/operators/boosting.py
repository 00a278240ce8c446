"""Second-order gradient boosting of histogram trees for two classes.

Features are cut into bins once and rows are packed into blocks, which stay in memory as
arrays, since a tree is many short jobs. A tree grows level by level. A level is one job:
every task adds up the gradients and Hessians of its rows per (node, feature, bin). Where
the sums of all tasks are few bytes the driver adds them; else the sums of one (node,
feature) meet in one task, which finds its best cut, and the driver gets one row for each
(node, feature). With G and H the sums of a node, its leaf value is -G / (H + lambda), and
a cut gains

    (GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda)) / 2 - gamma.

Rows are drawn per tree by a hash of their id, columns by the tree's number. The first
level of a tree adds the tree before to the margins; they are checkpointed every few trees.
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
from sparktab.session import cut_lineage, drop_finished_shuffles, release, remove

MAX_BINS = 256
#: Trees between two checkpoints of the margins.
KEEP_TREES = 10
#: Sums of a level that the driver adds itself, over all tasks.
DRIVER_BYTES = 1 << 25
#: A cut must gain more than this.
LEAST_GAIN = 1e-6
BLOCK = "bins binary, label binary, hash binary, margin binary"
#: A tree in arrays by node: feature (-1: leaf), last bin that goes left, both children, leaf value.
FIELDS = ["feature", "bin", "left", "right", "value"]


def bin_edges(df: DataFrame, width: int, bins: int = MAX_BINS) -> list[list[float]]:
    """Ascending cut points of every feature: all distinct values but the largest if there are at most ``bins``, else
    quantiles. x falls into bin b if edges[b - 1] < x <= edges[b]."""
    x = df.select(vector_to_array("features").alias("x"))
    few = few_values(x, width, 2 * bins)
    shares = [i / bins for i in range(1, bins)]
    wanted = [F.percentile_approx(F.col("x")[j], shares, 100 * bins).alias(f"q{j}") for j in range(width) if j not in few]
    row = x.agg(*wanted).first() if wanted else {}
    out = []
    for j in range(width):
        values = few[j] if j in few else list(row[f"q{j}"])
        if j in few and len(values) <= bins:
            out.append(values[:-1])
        else:
            at = [values[min(len(values) - 1, i * len(values) // bins)] for i in range(1, bins)] if j in few else values
            out.append(sorted(set(at)))
    return out


def few_values(x: DataFrame, width: int, most: int) -> dict[int, list[float]]:
    """The distinct values, ascending, of every feature that has at most ``most``. A task names no more for a feature."""

    def run(batches):
        seen: dict[int, np.ndarray] = {j: np.array([]) for j in range(width)}
        many = set()
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for j in list(seen):
                seen[j] = np.union1d(seen[j], values[:, j])
                if len(seen[j]) > most:
                    many.add(j)
                    del seen[j]
        for j in range(width):
            found = pa.array([None]) if j in many else pa.array(seen[j])
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(found), pa.int32()), found.cast(pa.float64())], ["f", "v"])

    # a null says that one task alone saw too many
    listed = F.when(~F.bool_or(F.col("v").isNull()) & (F.size(F.collect_set("v")) <= most), F.sort_array(F.collect_set("v")))
    rows = x.where("x IS NOT NULL").mapInArrow(run, "f int, v double").groupBy("f").agg(listed.alias("values")).collect()
    found = {r["f"]: r["values"] for r in rows}
    return {j: list(found.get(j, [])) for j in range(width) if found.get(j, []) is not None}


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes and a seed."""
    x = x.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def packed(df: DataFrame, edges: list[list[float]], row_id: str, margin: float) -> DataFrame:
    """One row for each Arrow batch: bins (rows x features), labels, hashes and margins."""
    kind = np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            bins = np.stack([np.searchsorted(e, values[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(kind)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.uint8)
            columns = [bins, label, batch.column("hash").to_numpy(), np.full(len(bins), margin)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], [c.split()[0] for c in BLOCK.split(", ")])

    rows = df.select(vector_to_array("features").alias("x"), "label", F.xxhash64(row_id).alias("hash"))
    return rows.mapInArrow(run, BLOCK)


def leaf_of(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node at which each row ends in a tree, finished or growing."""
    feature, last, left, right = (np.asarray(tree[f], np.int64) for f in FIELDS[:4])
    node = np.zeros(len(bins), np.int64)
    while True:
        own = feature[node]
        inner = np.flatnonzero(own >= 0)
        if not len(inner):
            return node
        at = node[inner]
        goes_right = bins[inner, own[inner]] > last[at]
        node[inner] = np.where(goes_right, right[at], left[at])


def opened(blocks: DataFrame, width: int, kind: type) -> RDD:
    """(bins, labels, hashes, margins) of each block."""
    return blocks.rdd.map(
        lambda row: (np.frombuffer(row["bins"], kind).reshape(-1, width), np.frombuffer(row["label"], np.uint8), np.frombuffer(row["hash"], np.int64), np.frombuffer(row["margin"]))
    )


def best_cut(g: np.ndarray, h: np.ndarray, penalty: float, least_hessian: float) -> tuple[float, int, float, float]:
    """(gain, bin, G left, H left) of the best cut of one histogram; the first of equal ones; gain is 0 if there is none."""
    total_g, total_h = g.sum(), h.sum()
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    score = lambda a, b: a * a / (b + penalty)
    gain = (score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)) / 2
    gain = np.where((left_h >= least_hessian) & (right_h >= least_hessian), gain, 0.0)
    if not len(gain):
        return 0.0, 0, 0.0, 0.0
    # sums of other orders of the rows differ in their last digits, equal cuts must not
    best = int(np.argmax(gain >= gain.max() * (1 - 1e-12)))
    return float(gain[best]), best, float(left_g[best]), float(left_h[best])


def level_cuts(data: RDD, tree: dict, nodes: list[int], columns: list[int], shape: tuple, seed: int, p: dict) -> list[dict]:
    """(node, feature, gain, bin, gl, hl, g, h) of the best cut of every node in every column."""
    n_bins = shape[1]
    slots = np.full(len(tree["feature"]), -1, np.int64)
    slots[nodes] = np.arange(len(nodes))
    size = len(nodes) * n_bins
    names = ["node", "feature", "gain", "bin", "gl", "hl", "g", "h"]

    def add(blocks):
        sums = np.zeros((len(columns), 2, size))
        for bins, label, row_hash, margin in blocks:
            slot = slots[leaf_of(tree, bins)]
            drawn = slot >= 0
            if p["subsample"] < 1:
                drawn &= mixed(row_hash, seed) < p["subsample"]
            drawn = np.flatnonzero(drawn)
            share = 1.0 / (1.0 + np.exp(-margin[drawn]))
            g, h = share - label[drawn], np.maximum(share * (1 - share), 1e-16)
            first = slot[drawn] * n_bins
            for c, column in enumerate(columns):
                at = first + bins[drawn, column]
                sums[c, 0] += np.bincount(at, g, size)
                sums[c, 1] += np.bincount(at, h, size)
        yield sums

    def choose(key, sums):
        node, c = key
        cut = best_cut(sums[0], sums[1], p["reg_lambda"], p["min_child_weight"])
        return dict(zip(names, (nodes[node], columns[c], *cut, float(sums[0].sum()), float(sums[1].sum()))))

    def by_key(sums):
        cells = sums.reshape(len(columns), 2, len(nodes), n_bins)
        return [((int(n), int(c)), cells[c, :, n].copy()) for c, n in np.argwhere(cells[:, 1].any(axis=2))]

    parts = data.mapPartitions(add)
    if data.getNumPartitions() * len(columns) * size * 16 <= DRIVER_BYTES:
        return [choose(*pair) for pair in by_key(sum(parts.collect(), np.zeros((len(columns), 2, size))))]
    n_parts = min(len(nodes) * len(columns), data.getNumPartitions())
    return parts.flatMap(by_key).reduceByKey(np.add, n_parts).map(lambda pair: choose(*pair)).collect()


def grow(data: RDD, number: int, shape: tuple, p: dict) -> dict | None:
    """One more tree over the margins of ``data``; None if no row is drawn."""
    width = shape[0]
    rng = np.random.default_rng([p["random_state"], number])
    columns = sorted(rng.choice(width, max(1, int(p["colsample_bytree"] * width)), replace=False).tolist())
    seed = int(rng.integers(1 << 62))
    tree = {"feature": [-1], "bin": [0], "left": [0], "right": [0], "value": [0.0]}
    value = lambda g, h: -p["learning_rate"] * g / (h + p["reg_lambda"])
    frontier = [0]
    for _ in range(p["max_depth"]):
        found = {}
        for row in level_cuts(data, tree, frontier, columns, shape, seed, p):
            if row["node"] == 0:
                tree["value"][0] = value(row["g"], row["h"])
            old = found.get(row["node"])
            # equal gains up to rounding: the first feature
            better = old is None or row["gain"] > old["gain"] * (1 + 1e-12) or (row["gain"] >= old["gain"] * (1 - 1e-12) and row["feature"] < old["feature"])
            if better:
                found[row["node"]] = row
        if not found and frontier == [0]:
            return None
        nxt = []
        for node in frontier:
            cut = found.get(node)
            if cut is None or cut["gain"] - p["gamma"] <= LEAST_GAIN:
                continue
            left = len(tree["feature"])
            tree["feature"][node], tree["bin"][node] = cut["feature"], cut["bin"]
            tree["left"][node], tree["right"][node] = left, left + 1
            for g, h in ((cut["gl"], cut["hl"]), (cut["g"] - cut["gl"], cut["h"] - cut["hl"])):
                for field, v in zip(FIELDS, (-1, 0, 0, 0, value(g, h))):
                    tree[field].append(v)
            nxt += [left, left + 1]
        frontier = nxt
        if not frontier:
            break
    return tree


def fit_boosted(df: DataFrame, p: dict, width: int, row_id: str) -> BoostedTrees:
    """Trees for labels 0 and 1. p: n_estimators, max_depth, learning_rate, subsample, colsample_bytree, reg_lambda, gamma,
    min_child_weight, base_score, max_bins, random_state."""
    if p["max_depth"] is None or p["max_depth"] < 1:
        raise ValueError("max_depth: at least 1")
    edges = bin_edges(df, width, p["max_bins"])
    kind = np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16
    shape = (width, max(map(len, edges), default=0) + 1, kind)
    base = math.log(p["base_score"] / (1 - p["base_score"]))
    blocks = cut_lineage(packed(df, edges, row_id, base))
    data, older = opened(blocks, width, kind).persist(StorageLevel.MEMORY_AND_DISK), None
    trees: list[dict] = []
    stored: list[str] = []
    for number in range(p["n_estimators"]):
        tree = grow(data, number, shape, p)
        if older is not None:
            older.unpersist()
            older = None
        if tree is None:
            break
        trees.append(tree)
        if data.isCheckpointed():
            # what the margins before were read from is not needed any more
            stored.append(data.getCheckpointFile())
            remove(df.sparkSession, *stored[:-1])
            drop_finished_shuffles(df.sparkSession)
            del stored[:-1]
        older, data = data, with_margins(data, tree).persist(StorageLevel.MEMORY_AND_DISK)
        if len(trees) % KEEP_TREES == 0:
            data.checkpoint()
    for kept in (data, older):
        if kept is not None:
            kept.unpersist()
    remove(df.sparkSession, *stored)
    release(blocks)
    cut_at = lambda t: [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(t["feature"], t["bin"])]
    listed = [[t["feature"], cut_at(t), t["left"], t["right"], t["value"]] for t in trees]
    return BoostedTrees(trees=listed, base=base)


def with_margins(data: RDD, tree: dict) -> RDD:
    """The blocks with a tree added to their margins."""
    value = np.asarray(tree["value"])
    return data.map(lambda block: (*block[:3], block[3] + value[leaf_of(tree, block[0])]))


class BoostedTrees(_Stage, Model):
    """Sum of trees; the probability is its logistic function."""

    trees = Param(Params._dummy(), "trees", "[features, thresholds, left, right, values] of each tree")
    base = Param(Params._dummy(), "base", "margin without trees")

    @keyword_only
    def __init__(self, trees=None, base=None):
        super().__init__()
        self._fill(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, base = self.value("trees"), self.value("base")

        @F.pandas_udf("double")
        def margin(vectors: pd.Series) -> pd.Series:
            if vectors.empty:
                return pd.Series([], dtype=float)
            x = np.stack(vectors.to_numpy())
            total = np.full(len(x), base)
            for feature, threshold, left, right, value in trees:
                feature, left, right = (np.asarray(a, np.int64) for a in (feature, left, right))
                threshold, node = np.asarray(threshold), np.zeros(len(x), np.int64)
                while True:
                    inner = np.flatnonzero(feature[node] >= 0)
                    if not len(inner):
                        break
                    at = node[inner]
                    node[inner] = np.where(x[inner, feature[at]] > threshold[at], right[at], left[at])
                total += np.asarray(value)[node]
            return pd.Series(total)

        share = 1 / (1 + F.exp(-F.col("_margin")))
        return (
            df.withColumn("_margin", margin(vector_to_array("features")))
            .withColumn("probability", array_to_vector(F.array(1 - share, share)))
            .withColumn("prediction", (share > 0.5).cast("double"))
            .drop("_margin")
        )

    def nodes(self) -> list[tuple]:
        """(tree, node, feature, threshold, left, right, value) of all nodes; feature is -1 at a leaf."""
        return [(t, n, *row) for t, tree in enumerate(self.value("trees")) for n, row in enumerate(zip(*tree))]
