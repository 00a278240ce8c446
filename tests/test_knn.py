import numpy as np
import pytest

from sparktab.operators import knn


def tables(spark, t, q):
    train = spark.createDataFrame(
        [(i, float(i % 3), [float(x) for x in r]) for i, r in enumerate(t)],
        "tid bigint, label double, vec array<double>",
    )
    queries = spark.createDataFrame(
        [(i, [float(x) for x in r]) for i, r in enumerate(q)], "qid bigint, vec array<double>"
    )
    return queries, train


def brute(t, q, k):
    out = {}
    for i, row in enumerate(q):
        d = np.sqrt(((row - t) ** 2).sum(1))
        for rank, j in enumerate(np.lexsort((np.arange(len(t)), d))[:k], 1):
            out[(i, rank)] = (int(j), float(d[j]))
    return out


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("cells", [4096, 60])
def test_search_is_exact(spark, monkeypatch, hot, cells):
    monkeypatch.setattr(knn, "ROWS_PER_CELL", cells)
    monkeypatch.setattr(knn, "TILE_ROWS", 64)
    rng = np.random.default_rng(5)
    t, q = np.round(rng.normal(size=(500, 3)), 1), np.round(rng.normal(size=(90, 3)), 1)
    if hot:
        t[:170], q[:30] = t[0], t[0]
    found = knn.nearest(*tables(spark, t, q), 5).collect()
    assert {(r["qid"], r["rank"]): (r["tid"], r["distance"]) for r in found} == brute(t, q, 5)


def test_more_neighbours_than_rows(spark):
    t, q = np.array([[0.0], [1.0]]), np.array([[0.2]])
    assert knn.nearest(*tables(spark, t, q), 5).count() == 2


def test_no_training_rows(spark):
    queries, train = tables(spark, np.array([[0.0]]), np.array([[0.2]]))
    assert knn.nearest(queries, train.where("tid < 0"), 5).count() == 0


def test_votes(spark):
    near = spark.createDataFrame(
        [(0, 1.0, 0.5), (0, 0.0, 1.0), (0, 0.0, 1.0), (1, 1.0, 0.0), (1, 0.0, 0.1), (1, 0.0, 0.1)],
        "qid bigint, label double, distance double",
    )
    plain = {r["qid"]: r for r in knn.vote(near, 2).collect()}
    assert plain[0]["prediction"] == 0.0 and plain[0]["probability"] == pytest.approx([2 / 3, 1 / 3])
    weighted = {r["qid"]: r for r in knn.vote(near, 2, "distance").collect()}
    assert weighted[0]["probability"] == pytest.approx([0.5, 0.5])
    assert weighted[0]["prediction"] == 0.0
    assert weighted[1]["probability"] == pytest.approx([0.0, 1.0])
    with pytest.raises(ValueError):
        knn.vote(near, 2, "other")


def test_a_stored_index_gives_the_same_neighbours(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(knn, "ROWS_PER_CELL", 60)
    rng = np.random.default_rng(6)
    t, q = rng.normal(size=(400, 3)), rng.normal(size=(50, 3))
    queries, train = tables(spark, t, q)
    knn.build_index(train).save(str(tmp_path / "index"))
    index = knn.CellIndex.load(spark, str(tmp_path / "index"))
    assert index.rows.sum() == 400 and len(index.pivots) > 1
    monkeypatch.setattr(knn, "build_index", None)  # not built again
    found = knn.search(queries, index, 5).collect()
    assert {(r["qid"], r["rank"]): (r["tid"], r["distance"]) for r in found} == brute(t, q, 5)


def test_an_empty_index_can_be_stored(spark, tmp_path):
    queries, train = tables(spark, [[1.0, 2.0]], [[0.0, 0.0]])
    knn.build_index(train.where("tid < 0")).save(str(tmp_path / "index"))
    index = knn.CellIndex.load(spark, str(tmp_path / "index"))
    assert knn.search(queries, index, 3).count() == 0


def test_cells_of_fewer_rows_than_neighbours(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROWS_PER_CELL", 2)
    rng = np.random.default_rng(7)
    t, q = np.round(rng.normal(size=(300, 2)) * 100, 1), np.round(rng.normal(size=(60, 2)) * 100, 1)
    t[:9] = q[:9] = 1e6  # rounding of the product form is far more than the distances
    t[:9, 0] += np.arange(9) * 1e-6
    found = knn.nearest(*tables(spark, t, q), 7).collect()
    assert {(r["qid"], r["rank"]): (r["tid"], r["distance"]) for r in found} == brute(t, q, 7)


def test_a_task_holds_few_distances():
    assert knn.GAPS_AT_ONCE * 8 <= 4 << 20
