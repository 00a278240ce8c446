"""Second-order boosting against a plain version of the same sums."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparktab.operators import boosting, estimators
from sparktab.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
P = {**estimators.resolve_parameters("xgboost"), **estimators.BOOSTING, "subsample": 1.0, "colsample_bytree": 1.0}


def plain(x, y, rounds, depth, p):
    """Exact trees over all cuts, as nested tuples (feature, threshold, left, right) or leaf values."""
    margin = np.full(len(y), math.log(p["base_score"] / (1 - p["base_score"])))
    trees = []
    for _ in range(rounds):
        share = 1 / (1 + np.exp(-margin))
        g, h = share - y, share * (1 - share)

        def build(rows, level):
            value = -p["learning_rate"] * g[rows].sum() / (h[rows].sum() + p["reg_lambda"])
            best = (1e-6 + p["gamma"], None)
            for f in range(x.shape[1]) if level < depth else ():
                for t in np.unique(x[rows, f])[:-1]:
                    low, high = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                    if min(h[low].sum(), h[high].sum()) < p["min_child_weight"]:
                        continue
                    score = lambda r: g[r].sum() ** 2 / (h[r].sum() + p["reg_lambda"])
                    gain = (score(low) + score(high) - score(rows)) / 2
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, t, low, high))
            if best[1] is None:
                margin[rows] += value
                return value
            f, t, low, high = best[1]
            return (f, float(t), build(low, level + 1), build(high, level + 1))

        trees.append(build(np.arange(len(y)), 0))
    return trees


def nested(tree, node=0):
    feature, threshold, left, right, value = (column[node] for column in tree)
    return (feature, threshold, nested(tree, left), nested(tree, right)) if feature >= 0 else value


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and math.isclose(a, b, rel_tol=1e-9)


@pytest.fixture(scope="module")
def table(spark):
    cells = [F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")]
    rows = fx.clf_base(spark, SF).select(array_to_vector(F.array(*cells)).alias("features"), F.col("target").cast("double").alias("label"), "row_id")
    return rows.repartition(5).persist()


def arrays(df):
    rows = df.select("features", "label").collect()
    return np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])


@pytest.mark.parametrize("change", [{}, {"reg_lambda": 5.0, "min_child_weight": 40.0, "gamma": 3.0}, {"base_score": 0.2, "learning_rate": 0.3}])
def test_trees_equal_the_plain_ones(table, change):
    p = {**P, **change, "n_estimators": 3, "max_depth": 2}
    model = boosting.fit_boosted(table, p, 3, "row_id")
    wanted = plain(*arrays(table), 3, 2, p)
    assert all(same(nested(t), w) for t, w in zip(model.value("trees"), wanted, strict=True))


def test_margins_carry_over_checkpoints(table, monkeypatch):
    p = {**P, "n_estimators": 7, "max_depth": 2}
    whole = boosting.fit_boosted(table, p, 3, "row_id").nodes()
    monkeypatch.setattr(boosting, "KEEP_TREES", 2)
    cut = boosting.fit_boosted(table, p, 3, "row_id").nodes()
    assert [n[:4] for n in whole] == [n[:4] for n in cut]
    assert np.allclose([n[6] for n in whole], [n[6] for n in cut])


def test_probabilities_follow_the_trees_and_survive_saving(table, tmp_path):
    p = {**P, "n_estimators": 3, "max_depth": 2}
    model = boosting.fit_boosted(table, p, 3, "row_id")
    x, _ = arrays(table)
    trees = [nested(t) for t in model.value("trees")]
    walk = lambda t, v: t if not isinstance(t, tuple) else walk(t[2] if v[t[0]] <= t[1] else t[3], v)
    wanted = sorted(1 / (1 + math.exp(-sum(walk(t, v) for t in trees))) for v in x)
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        out = m.transform(table).collect()
        assert np.allclose(sorted(r.probability[1] for r in out), wanted)
        assert all(r.prediction == (r.probability[1] > 0.5) for r in out)


def test_draws_rows_and_columns(spark, table):
    p = {**P, "n_estimators": 6, "max_depth": 1, "subsample": 0.5, "colsample_bytree": 0.34}
    nodes = boosting.fit_boosted(table, p, 3, "row_id").nodes()
    used = {n[2] for n in nodes if n[2] >= 0}
    assert len(used) > 1 and used != {0}
    again = boosting.fit_boosted(table.repartition(3), p, 3, "row_id").nodes()
    assert [n[:4] for n in nodes] == [n[:4] for n in again]
    hashes = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 20_000)
    drawn = [boosting.mixed(hashes, seed) < 0.5 for seed in (1, 2)]
    assert all(abs(d.mean() - 0.5) < 0.02 for d in drawn) and abs((drawn[0] & drawn[1]).mean() - 0.25) < 0.02


def test_edges(spark):
    rows = spark.range(1000).select(array_to_vector(F.array((F.col("id") % 7).cast("double"), F.col("id").cast("double"), F.lit(3.0))).alias("features"))
    few, many, one = boosting.bin_edges(rows, 3, 16)
    assert few == [0, 1, 2, 3, 4, 5] and one == []
    assert len(many) <= 15 and many == sorted(many) and max(np.diff([0, *many, 999])) < 150


def test_only_constants_give_one_leaf_a_tree(spark):
    rows = spark.range(40).select(array_to_vector(F.array(F.lit(1.0), F.lit(2.0))).alias("features"), (F.col("id") % 4 == 0).cast("double").alias("label"), "id")
    model = boosting.fit_boosted(rows, {**P, "n_estimators": 2, "max_depth": 3}, 2, "id")
    assert [len(t[0]) for t in model.value("trees")] == [1, 1]
    assert model.value("trees")[0][4][0] < 0


def test_few_values_are_counted_exactly(spark):
    rows = spark.range(0, 5000, 1, 4).select(F.array((F.col("id") % 512).cast("double"), (F.col("id") % 513).cast("double"), F.col("id").cast("double"), F.lit(2.0)).alias("x"))
    assert boosting.few_values(rows, 4, 512) == {0: list(range(512)), 3: [2.0]}
    assert boosting.few_values(rows.where("false"), 1, 5) == {0: []}


def test_sums_of_levels_are_added_by_the_driver_or_by_tasks(table, monkeypatch):
    p = {**P, "n_estimators": 3, "max_depth": 3}
    whole = boosting.fit_boosted(table, p, 3, "row_id").nodes()
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)
    dealt = boosting.fit_boosted(table, p, 3, "row_id").nodes()
    assert [n[:4] for n in whole] == [n[:4] for n in dealt]
    assert np.allclose([n[6] for n in whole], [n[6] for n in dealt])
