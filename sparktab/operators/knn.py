"""Exact k nearest neighbours between two tables of vectors.

The training rows are grouped around pivot rows, whose number grows with the table: cells
of ROWS_PER_CELL rows, beyond that size squared as many cells as rows in a cell. A query first
visits the cells nearest to it; the k-th distance found there then rules out, by the
triangle inequality, every cell that cannot hold a closer row, and only the others
are visited. Cells are cut into tiles of bounded size on both sides, so a cell that
holds a third of all rows becomes many tasks, and each tile returns at most k rows
per query. The result is exact for any data; pruning only saves work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktab.session import cut_lineage

TILE_ROWS = 8192
ROWS_PER_CELL = 4096
#: Distances held at once: a slice stays in the processor's cache, and a task's memory does not grow with the cells.
GAPS_AT_ONCE = 1 << 18
SLACK = 1e-9


def _pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the product form; good to about SLACK of the norms."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def _tile_topk(k: int):
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The k nearest right rows of every left row of one tile."""
        names = ["qid", "tid", "label", "distance"]
        if left.empty or right.empty:
            return pd.DataFrame({n: [] for n in names})
        right = right.sort_values("tid", kind="stable").reset_index(drop=True)
        t = np.stack(right["vec"].to_numpy())
        q_all = np.stack(left["vec"].to_numpy())
        t_norm = float((t * t).sum(1).max())
        out = []
        for start in range(0, len(q_all), 512):
            q = q_all[start : start + 512]
            rough = _pairwise(q, t)
            limit = min(k, len(t)) - 1
            edge = np.partition(rough, limit, axis=1)[:, limit]
            edge = edge + SLACK * (1.0 + t_norm + (q * q).sum(1))
            rows, cols = np.nonzero(rough <= edge[:, None])
            exact = np.sqrt(((q[rows] - t[cols]) ** 2).sum(1))
            order = np.lexsort((cols, exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            first = np.searchsorted(rows, rows, side="left")
            keep = np.arange(len(rows)) - first < k
            out.append(
                pd.DataFrame(
                    {
                        "qid": left["qid"].to_numpy()[start + rows[keep]],
                        "tid": right["tid"].to_numpy()[cols[keep]],
                        "label": right["label"].to_numpy()[cols[keep]],
                        "distance": exact[keep],
                    }
                )
            )
        return pd.concat(out, ignore_index=True)

    return best


def _tile_join(queries: DataFrame, train: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Candidates (qid, tid, label, distance) of queries(cell, qid, vec) in their cells(cell, n)."""

    def tiles(n: str) -> Column:
        return F.ceil(F.col(n) / TILE_ROWS).cast("int")

    visits = queries.groupBy("cell").agg(F.count("*").alias("visits"))
    cut = cut_lineage(
        cells.join(visits, "cell").select("cell", tiles("n").alias("subs"), tiles("visits").alias("chunks"))
    )

    def part(column: str, count: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    # One row per cell, at most the square root of the training rows. Fresh aliases, because
    # both sides may come from the same table.
    left = queries.join(F.broadcast(cut), "cell").select(
        F.col("cell").alias("cell"),
        F.col("qid").alias("qid"),
        F.col("vec").alias("vec"),
        part("qid", "chunks").alias("chunk"),
        every("subs").alias("sub"),
    )
    right = train.join(F.broadcast(cut), "cell").select(
        "cell",
        "tid",
        "label",
        "vec",
        part("tid", "subs").alias("sub"),
        every("chunks").alias("chunk"),
    )
    keys = ["cell", "sub", "chunk"]
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *train.schema]}
    schema = f"qid {kind['qid']}, tid {kind['tid']}, label {kind['label']}, distance double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_tile_topk(k), schema)


def _keep_topk(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("distance", "tid")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class CellIndex:
    """Training rows by cell: placed(tid, label, vec, cell), and for each cell its pivot, number of rows and radius.
    The arrays have one entry for each pivot, of which there are at most the square root of the rows."""

    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    placed: DataFrame

    def save(self, path: str) -> None:
        """The rows in ranges of cells, and the table of cells."""
        self.placed.repartitionByRange("cell", "tid").sortWithinPartitions("cell").write.parquet(f"{path}/rows")
        cells = [(i, int(n), float(r), p.tolist()) for i, (n, r, p) in enumerate(zip(self.rows, self.radius, self.pivots))]
        table = self.placed.sparkSession.createDataFrame(cells, "cell int, n bigint, radius double, pivot array<double>")
        table.coalesce(1).write.parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        """Reads the table of cells only; the rows stay where they are until a search visits their cells."""
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        pivots = np.array([c["pivot"] for c in cells])
        rows, radius = (np.array([c[f] for c in cells] or [0]) for f in ("n", "radius"))
        return cls(pivots, rows, radius, spark.read.parquet(f"{path}/rows"))


def _slices(vectors: pd.Series, n_pivots: int) -> Iterator[np.ndarray]:
    """The vectors in parts whose distances to all pivots fit in memory."""
    step = max(1, GAPS_AT_ONCE // max(1, n_pivots))
    for low in range(0, len(vectors), step):
        yield np.stack(vectors.iloc[low : low + step].to_numpy())


def build_index(train: DataFrame) -> CellIndex:
    """The index of train(tid, label, vec)."""
    n = train.count()
    n_cells = max(1, math.ceil(n / max(ROWS_PER_CELL, math.isqrt(n))))

    # Chosen by hash so that a retry chooses the same ones.
    chosen = train.orderBy(F.md5(F.col("tid").cast("string")), "tid").limit(n_cells)
    pivots = np.array([r["vec"] for r in chosen.select("vec").collect()])

    @F.pandas_udf("struct<cell:int,gap:double>")
    def to_cell(vectors: pd.Series) -> pd.DataFrame:
        cells, gaps = [], []
        for x in _slices(vectors, len(pivots)):
            cell = _pairwise(x, pivots).argmin(1).astype("int32")
            cells.append(cell)
            gaps.append(np.sqrt(((x - pivots[cell]) ** 2).sum(1)))
        return pd.DataFrame({"cell": np.concatenate(cells), "gap": np.concatenate(gaps)})

    placed = cut_lineage(
        train.withColumn("at", to_cell("vec")).select("tid", "label", "vec", "at.cell", "at.gap")
    )
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()
    known = {r["cell"]: (r["n"], r["radius"]) for r in stats}
    rows = np.array([known.get(c, (0, 0.0))[0] for c in range(n_cells)])
    radius = np.array([known.get(c, (0, 0.0))[1] for c in range(n_cells)])
    return CellIndex(pivots, rows, radius, placed.drop("gap"))


def nearest(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(qid, tid, label, distance, rank) from queries(qid, vec) and train(tid, label, vec).

    ``vec`` is array<double>. Ties go to the smaller ``tid``.
    """
    return search(queries, build_index(train), k)


def search(queries: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """``nearest`` over an index that was built or loaded before."""
    pivots, rows, radius, placed = index.pivots, index.rows, index.radius, index.placed
    k = min(k, int(rows.sum()))
    full = [(i, int(n)) for i, n in enumerate(rows) if n]
    cells = queries.sparkSession.createDataFrame(full, "cell int, n bigint")
    id_type = queries.schema["qid"].dataType.simpleString()

    p_norm = float((pivots * pivots).sum(1).max()) if len(pivots) else 0.0

    def rounding(x: np.ndarray) -> np.ndarray:
        return SLACK * (1.0 + p_norm + (x * x).sum(1))

    def home_cells(x: np.ndarray, rough: np.ndarray) -> list[np.ndarray]:
        """The nearest cells that together hold at least k rows, the same ones whatever slice a row is in."""
        least = rough <= (rough.min(1) + rounding(x))[:, None]
        unclear = ~least.any(1)  # not a number
        least[unclear, 0] = True
        near, cols = np.nonzero(least)
        exact = ((x[near] - pivots[cols]) ** 2).sum(1)
        order = np.lexsort((cols, exact, near))
        first = cols[order][np.searchsorted(near[order], np.arange(len(x)))]
        out = list(first.astype("int32")[:, None])
        for i in np.flatnonzero(unclear | (rows[first] < k)):
            order = np.argsort(((x[i] - pivots) ** 2).sum(1), kind="stable")
            out[i] = order[: (np.cumsum(rows[order]) < k).sum() + 1].astype("int32")
        return out

    @F.pandas_udf("array<int>")
    def first_cells(vectors: pd.Series) -> pd.Series:
        if not len(pivots):
            return pd.Series([np.empty(0, "int32")] * len(vectors))
        return pd.Series([home for x in _slices(vectors, len(pivots)) for home in home_cells(x, _pairwise(x, pivots))])

    def other_cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """qid, vec and the cells to visit, a slice at a time."""
        for part in parts:
            done, reach = 0, part["bound"].to_numpy() * (1 + SLACK) + SLACK
            for x in _slices(part["vec"], len(pivots)):
                own = slice(done, done + len(x))
                done += len(x)
                rough = _pairwise(x, pivots)
                limit = (reach[own, None] + radius[None, :]) ** 2 + rounding(x)[:, None]
                close = (rough <= limit) & (rows > 0)[None, :]
                for i, home in enumerate(home_cells(x, rough)):
                    close[i, home] = False
                some = part.iloc[own][["qid", "vec"]]
                yield some.assign(cells=[np.flatnonzero(c).astype("int32") for c in close])

    near = queries.select(F.explode(first_cells("vec")).alias("cell"), "qid", "vec")
    nearest_first = _keep_topk(_tile_join(near, placed, cells, k), k)
    if len(rows) == 1:  # the one cell holds all rows
        return nearest_first
    first = cut_lineage(nearest_first.drop("rank"))
    bounds = first.groupBy("qid").agg(F.max("distance").alias("bound"))
    rest = cut_lineage(
        queries.join(bounds, "qid")
        .select("qid", "vec", "bound")
        .mapInPandas(other_cells, f"qid {id_type}, vec array<double>, cells array<int>")
        .select(F.explode("cells").alias("cell"), "qid", "vec")
    )
    if rest.isEmpty():
        return _keep_topk(first, k)
    second = _tile_join(rest, placed, cells, k)
    return _keep_topk(first.unionByName(second), k)


def vote(neighbours: DataFrame, n_classes: int, weights: str = "uniform") -> DataFrame:
    """(qid, prediction, probability) from class numbers in ``label``.

    With ``distance`` weights a neighbour counts 1/distance; neighbours at distance
    zero take the whole vote. The smaller class wins ties.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"Unknown weights: {weights}")
    d = F.col("distance")
    if weights == "uniform":
        w_zero = w_far = F.lit(1.0)
    else:
        w_zero = F.when(d == 0, 1.0).otherwise(0.0)
        w_far = F.when(d > 0, 1.0 / d).otherwise(0.0)
    touched = F.max(F.when(d == 0, 1).otherwise(0)) == 1

    def share(c: int) -> Column:
        own = F.col("label") == c
        zero = F.sum(F.when(own, w_zero).otherwise(0.0))
        far = F.sum(F.when(own, w_far).otherwise(0.0))
        return F.when(touched, zero).otherwise(far)

    votes = F.array(*[share(c) for c in range(n_classes)])
    sums = neighbours.groupBy("qid").agg(votes.alias("votes"))
    total = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x)
    return sums.withColumn("probability", F.transform("votes", lambda x: x / total)).select(
        "qid",
        (F.array_position("probability", F.array_max("probability")) - 1).cast("double").alias("prediction"),
        "probability",
    )
