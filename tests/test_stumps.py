"""Stumps at exact values against a scan of all cuts."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparktab.operators import estimators
from sparktab.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def plain(x, y, k, rounds, rate):
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        found = []
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, mass = x[order, f], np.eye(k)[y[order]] * w[order, None]
            upto, whole = np.cumsum(mass, axis=0), mass.sum(axis=0)
            gini = lambda m: m.sum(-1) - (m * m).sum(-1) / np.maximum(m.sum(-1), 1e-300)
            at = np.flatnonzero(v[:-1] < v[1:])
            found += [(g, f, v[i], upto[i], whole - upto[i]) for i, g in zip(at, gini(upto[at]) + gini(whole - upto[at]))]
        least = min(c[0] for c in found)
        _, f, t, left, right = min((c for c in found if c[0] <= least * (1 + 1e-12)), key=lambda c: c[1:3])
        a, b = left.argmax(), right.argmax()
        wrong = np.where(x[:, f] <= t, a, b) != y
        error = w[wrong].sum() / w.sum()
        power = rate * (math.log((1 - error) / error) + math.log(k - 1))
        out.append([f, float(t), float(a), float(b), power])
        w = w * np.exp(power * wrong)
    return out


@pytest.mark.parametrize("bins", [2, 7, 64])
def test_stumps_equal_a_scan_of_all_cuts(spark, bins):
    cells = [F.col(c).cast("double") for c in ("l_discount", "l_extendedprice", "l_quantity", "l_tax")]
    df = fx.clf_base(spark, SF).select(array_to_vector(F.array(*cells)).alias("features"), F.col("target").cast("double").alias("label")).repartition(4)
    rows = df.collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([int(r.label) for r in rows])
    got = estimators.fit_adaboost(df, 2, 4, 0.5, bins).value("stumps")
    wanted = plain(x, y, 2, 4, 0.5)
    assert [s[:4] for s in got] == [s[:4] for s in wanted]
    assert np.allclose([s[4] for s in got], [s[4] for s in wanted])


def test_three_classes_and_constant_features(spark):
    rng = np.random.default_rng(2)
    x = np.stack([rng.standard_normal(400), np.ones(400), rng.integers(0, 5, 400)], axis=1)
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 2] > 2)
    df = spark.createDataFrame([(v.tolist(), float(c)) for v, c in zip(x, y)], "v array<double>, label double").select(array_to_vector("v").alias("features"), "label")
    got = estimators.fit_adaboost(df, 3, 3, 0.5, 8).value("stumps")
    wanted = plain(x, y, 3, 3, 0.5)
    assert [s[:4] for s in got] == [s[:4] for s in wanted]
    constant = df.select(array_to_vector(F.array(F.lit(1.0))).alias("features"), "label")
    with pytest.raises(ValueError, match="better than chance"):
        estimators.fit_adaboost(constant, 3, 3, 0.5)


def test_rounds_read_packed_blocks(spark):
    """A table of many rows is a few packed blocks, and checkpoints of the weights change nothing."""
    rng = np.random.default_rng(5)
    x = np.stack([rng.standard_normal(3000), rng.integers(0, 9, 3000)], axis=1)
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.standard_normal(3000) > 1).astype(int)
    df = spark.createDataFrame([(v.tolist(), float(c)) for v, c in zip(x, y)], "v array<double>, label double").select(array_to_vector("v").alias("features"), "label").coalesce(2)
    cuts = estimators._quantile_cuts(df, 16)
    blocks = estimators._stump_blocks(df, cuts)
    assert blocks.count() == 2
    ends, n = estimators._bin_ends(blocks, cuts)
    assert n == 3000 and [e[0][1] for e in ends.values()] == x.min(axis=0).tolist() and [e[-1][2] for e in ends.values()] == x.max(axis=0).tolist()
    got = estimators.fit_adaboost(df, 2, 12, 0.5, 16).value("stumps")
    wanted = plain(x, y, 2, 12, 0.5)
    assert [s[:4] for s in got] == [s[:4] for s in wanted]
    assert np.allclose([s[4] for s in got], [s[4] for s in wanted])


@pytest.mark.parametrize("parts", [2, 1 << 12])
def test_bins_are_cut_again_until_no_part_can_hold_a_better_cut(spark, monkeypatch, parts):
    """Values of all sizes and signs in two bins; sums added by the driver or by tasks."""
    rng = np.random.default_rng(7)
    x = np.stack([rng.standard_normal(900) * 10.0 ** rng.integers(-9, 9, 900), rng.integers(-2, 3, 900) * 0.0], axis=1)
    x[:3, 0] = [0.0, -0.0, 1e300]
    y = (np.abs(x[:, 0]) > 3e-5).astype(int) ^ (rng.random(900) < 0.1)
    df = spark.createDataFrame([(v.tolist(), float(c)) for v, c in zip(x, y)], "v array<double>, label double").select(array_to_vector("v").alias("features"), "label").repartition(3)
    monkeypatch.setattr(estimators, "STUMP_PARTS", parts)
    monkeypatch.setattr(estimators, "DRIVER_BYTES", 0 if parts == 2 else estimators.DRIVER_BYTES)
    got = estimators.fit_adaboost(df, 2, 3, 0.5, 2).value("stumps")
    wanted = plain(x, y, 2, 3, 0.5)
    assert [s[:4] for s in got] == [s[:4] for s in wanted]
    assert np.allclose([s[4] for s in got], [s[4] for s in wanted])
