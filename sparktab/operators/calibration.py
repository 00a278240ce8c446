"""Sigmoid calibration of margins: P(1 | margin) = 1 / (1 + exp(a * margin + b)).

The margins come from models that have not seen their rows (one model for each fold).
Targets are smoothed by the class counts, so a separable table has a finite slope. a and
b are found by Newton steps; a step is one aggregation for the gradient and the Hessian
and one for the loss at all step lengths that are tried.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.operators.features import _Stage

FOLDS = 5
STEPS = 100
#: Step lengths are 1, 1/2, ... 2 ** -(LENGTHS - 1).
LENGTHS = 12
RIDGE, SMALL = 1e-12, 1e-5


def fold_of(row_id: str, seed: int, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(F.lit(int(seed)), row_id), F.lit(folds))


def held_out_margins(df: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], row_id: str, seed: int, folds: int = FOLDS) -> DataFrame:
    """(margin, label) of every row, by a model of the other folds. fit gives for a training table a function that adds
    ``margin``. A fold whose training table lacks a class is left to the model of all rows."""
    fold = fold_of(row_id, seed, folds)
    counts = {r["fold"]: r for r in df.groupBy(fold.alias("fold")).agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).collect()}
    ones, n = sum(r["ones"] for r in counts.values()), sum(r["n"] for r in counts.values())

    def of_fold(k: int) -> DataFrame:
        other_ones, others = ones - counts[k]["ones"], n - counts[k]["n"]
        train = df.where(fold != k) if 0 < other_ones < others else df
        return fit(train)(df.where(fold == k)).select("margin", "label")

    # the folds' jobs are independent of each other
    with ThreadPoolExecutor(max_workers=folds) as pool:
        parts = list(pool.map(of_fold, sorted(counts)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit_sigmoid(margins: DataFrame) -> tuple[float, float]:
    """a and b for a table (margin, label), label 0 or 1."""
    row = margins.agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).first()
    ones, zeros = row["ones"], row["n"] - row["ones"]
    target = F.when(F.col("label") == 1, (ones + 1) / (ones + 2)).otherwise(1 / (zeros + 2))
    f = F.col("margin")

    def loss(a: float, b: float) -> Column:
        z = F.lit(a) * f + F.lit(b)
        return F.sum(target * z + F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))

    a, b = 0.0, math.log((zeros + 1) / (ones + 1))
    now = margins.agg(loss(a, b).alias("v")).first()["v"]
    for _ in range(STEPS):
        z = F.lit(a) * f + F.lit(b)
        share = F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))
        spread, miss = share * (1 - share), target - share
        s = margins.agg(
            F.sum(f * f * spread).alias("aa"), F.sum(spread).alias("bb"), F.sum(f * spread).alias("ab"),
            F.sum(f * miss).alias("ga"), F.sum(miss).alias("gb"),
        ).first()
        aa, bb, ab, ga, gb = s["aa"] + RIDGE, s["bb"] + RIDGE, s["ab"], s["ga"], s["gb"]
        if abs(ga) < SMALL and abs(gb) < SMALL:
            break
        det = aa * bb - ab * ab
        da, db = -(bb * ga - ab * gb) / det, -(aa * gb - ab * ga) / det
        slope = ga * da + gb * db
        lengths = [0.5**i for i in range(LENGTHS)]
        tried = margins.agg(*[loss(a + t * da, b + t * db).alias(f"v{i}") for i, t in enumerate(lengths)]).first()
        good = next((i for i, t in enumerate(lengths) if tried[f"v{i}"] < now + 1e-4 * t * slope), None)
        if good is None:
            break
        a, b, now = a + lengths[good] * da, b + lengths[good] * db, tried[f"v{good}"]
    return a, b


class SigmoidCalibration(_Stage, Model):
    """``probability`` from the margin of class 1, the second entry of the vector ``margins``."""

    slope = Param(Params._dummy(), "slope", "a")
    offset = Param(Params._dummy(), "offset", "b")

    @keyword_only
    def __init__(self, slope=None, offset=None):
        super().__init__()
        self._fill(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        z = F.lit(self.value("slope")) * vector_to_array("margins")[1] + F.lit(self.value("offset"))
        share = F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))
        return df.withColumn("probability", array_to_vector(F.array(1 - share, share)))
