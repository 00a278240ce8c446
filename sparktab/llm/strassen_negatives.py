"""Hard negatives: exact integer scores of anchors against all rows, by Strassen multiplication of tiles.

Components become floor(256 * x). Anchors are cut into blocks, rows into groups, and each block meets each group in a
unit of its own; a unit holds its anchors and lets the rows pass in tiles. A tile's scores are the product of two
integer matrices by Strassen's seven products, odd sides padded with zeros; sums wrap in 64 bits, which is exact as
long as the scores themselves fit. Where they may not (components beyond some 2**24), the same recursion runs over
Python's integers.

Two passes keep heaps of the best k rows of each anchor, ties by the smaller id. The first multiplies only rows of an
anchor's own label and keeps its positives; the second multiplies all rows and keeps, for each positive, the rows of
other labels whose score is within the positive's window. A unit's heaps are merged by a ranking that Spark cuts to k
rows on both sides of its shuffle.

Defined cases: rows with a null id, a null label, a null vector or a null or non-finite component take no part; of
rows that share an id the one with the least (label, vector) takes part; shorter vectors are padded with zeros; an
empty vector scores 0; scores are compared as they are up to 38 digits, and returned as the nearest long; an anchor without positives or
a positive without negatives gives no row; the input's other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.llm import blocks

SCALE = 256
POSITIVES = NEGATIVES = 5
#: Sides of at most so many entries are multiplied directly.
LEAF = 32
#: Anchors of a block at most, and their components; rows of a group; scores of a tile.
ANCHORS, COMPONENTS, GROUP, TILE = 8192, 1 << 22, 65_536, 1 << 21
LOWEST, MOST = -(1 << 63), 10**38 - 1
#: Below every score of Python's integers.
BOTTOM = -(1 << 4096)


def padded(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns), a.dtype)
    out[: a.shape[0], : a.shape[1]] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The matrix product a @ b of integers (64 bits, modulo 2**64, or Python's)."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    h, i, j = -(-m // 2), -(-k // 2), -(-n // 2)
    a, b = padded(a, 2 * h, 2 * i), padded(b, 2 * i, 2 * j)
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), p1.dtype)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def whole(column: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of a list column of doubles as a matrix, zeros after short rows; Python's integers if they are large."""
    offsets = column.offsets.to_numpy()
    x = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    if len(x) and np.abs(x).max() >= 2.0**52 / scale:
        flat = np.array([int(np.floor(v * scale)) if abs(v) < 2.0**52 else int(v) * scale for v in x.tolist()] + [0], object)[:-1]
    else:
        flat = np.floor(x * scale).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), flat.dtype)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (padded(x, len(x), width) for x in (a, b))
    most = [int(np.abs(x).max()) if x.size else 0 for x in (a, b)]
    if a.dtype == object or b.dtype == object or most[0] * most[1] * width >= 1 << 56:
        a, b = a.astype(object), b.astype(object)
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    return strassen(a, np.ascontiguousarray(b.T))


class Heaps:
    """The k best (score, id) of each of n rows, higher scores first, then smaller ids; all heaps in three arrays."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(n, LOWEST, np.int64)

    def push(self, score: np.ndarray, ids: np.ndarray, valid: np.ndarray, rows: np.ndarray) -> None:
        """Offers row rows[i] the candidates of line i that are valid."""
        if not valid.any():
            return
        floor = self.floor[rows]
        if score.dtype == object:
            floor = np.where(floor == LOWEST, BOTTOM, floor.astype(object))
        if score.shape[1] > self.k:
            masked = np.where(valid, score, BOTTOM if score.dtype == object else LOWEST)
            ordered = np.sort(masked, axis=1) if masked.dtype == object else np.partition(masked, -self.k, axis=1)
            floor = np.maximum(floor, ordered[:, -self.k])
        i, j = np.nonzero(valid & (score >= floor[:, None]))
        self.merge(rows[i], score[i, j], ids[j])

    def merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, row)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda x: (row[x], -score[x], ids[x])), int)
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < self.k
        self.row, self.score, self.id = row[best], score[best], ids[best]
        full, at = np.unique(self.row, return_index=True)
        count = np.diff([*at.tolist(), len(self.row)])
        full, last = full[count == self.k], (at + count - 1)[count == self.k]
        if self.score.dtype == object:
            self.floor = self.floor.astype(object)
        self.floor[full] = self.score[last]


def as_decimals(x: np.ndarray) -> pa.Array:
    return pa.array([Decimal(max(-MOST, min(MOST, int(v)))) for v in x], pa.decimal128(38, 0))


def as_long(name: str) -> Column:
    low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in (LOWEST, -LOWEST - 1))
    return F.greatest(F.least(name, high), low).cast("long").alias(name)


def candidates(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part, once for each id."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where("id is not null and label is not null and vector is not null").where(F.forall("vector", finite))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")


def met(anchors: DataFrame, rows: DataFrame, n_blocks: int, n_groups: int) -> DataFrame:
    """Each block of anchors (side 0) followed by each group of rows (side 1), in one partition each."""
    block, group = (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n)).cast("int") for n in (n_blocks, n_groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"block": block, "side": F.lit(0)}).withColumn("group", every(n_groups))
    right = rows.withColumns({"group": group, "side": F.lit(1)}).withColumn("block", every(n_blocks))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartition(n_blocks * n_groups, "block", "group").sortWithinPartitions("block", "group", "side", "id")


def in_tiles(batches):
    """(anchors, tiles) of each unit: a table, and tables of its rows that come while they are asked for."""
    pending: list[pa.Table] = []

    def pieces():
        for batch in batches:
            key = [batch.column(c).to_numpy() for c in ("block", "group", "side")]
            new = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            for low, high in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if high > low:
                    yield (key[0][low], key[1][low]), key[2][low], pa.Table.from_batches([batch.slice(low, high - low)])

    now, anchors = None, None
    for unit, side, piece in pieces():
        if unit != now:
            if pending:
                yield now, anchors, None
            now, anchors, pending = unit, None, []
        if side == 0:
            pending.append(piece)
            continue
        if anchors is None:
            if not pending:
                continue
            anchors = pa.concat_tables(pending).combine_chunks()
        step = max(64, TILE // anchors.num_rows)
        for low in range(0, piece.num_rows, step):
            yield now, anchors, piece.slice(low, step).combine_chunks()
    if pending:
        yield now, anchors, None


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def positives(units: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the k best rows of the anchor's label in each unit."""

    def run(batches):
        now, heaps = None, None
        for unit, anchors, tile in in_tiles(batches):
            if unit != now:
                yield from told(heaps, ids) if now is not None else ()
                now, heaps = unit, None
            if tile is None:
                continue
            if heaps is None:
                ids, label, q = numbers(anchors, "id"), numbers(anchors, "label"), whole(anchors.column("vector").combine_chunks())
                heaps = Heaps(len(ids), k)
            other, its_label, r = numbers(tile, "id"), numbers(tile, "label"), whole(tile.column("vector").combine_chunks())
            for one in np.intersect1d(label, its_label):
                a, c = np.flatnonzero(label == one), np.flatnonzero(its_label == one)
                heaps.push(scores(q[a], r[c]), other[c], ids[a][:, None] != other[c][None, :], a)
        if now is not None:
            yield from told(heaps, ids)

    def told(heaps, ids):
        if heaps is not None and len(heaps.row):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[heaps.row]), pa.array(heaps.id), as_decimals(heaps.score)], ["anchor_id", "positive_id", "positive_score"]
            )

    return units.mapInArrow(run, "anchor_id long, positive_id long, positive_score decimal(38,0)")


def negatives(units: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, negative_id, negative_score): of each unit the k best rows of other labels
    in the window low * positive_score <= 100 * score <= high * positive_score. Anchors carry their positives."""

    def run(batches):
        now, heaps = None, None
        for unit, anchors, tile in in_tiles(batches):
            if unit != now:
                yield from told(heaps, whose) if now is not None else ()
                now, heaps = unit, None
            if tile is None:
                continue
            if heaps is None:
                ids, label, q = numbers(anchors, "id"), numbers(anchors, "label"), whole(anchors.column("vector").combine_chunks())
                given = anchors.column("positives").to_pylist()
                of = np.array([i for i, ps in enumerate(given) for _ in ps], np.int64)
                best = [(ids[i], p["positive_id"], int(p["positive_score"])) for i, ps in enumerate(given) for p in ps]
                large = any(abs(p) >= 1 << 56 for _, _, p in best)
                whose = [np.array(x, object if large and i == 2 else np.int64) for i, x in enumerate(zip(*best))]
                slot = np.arange(len(of)) - np.searchsorted(of, of)
                heaps = Heaps(len(of), k)
            other, its_label, r = numbers(tile, "id"), numbers(tile, "label"), whole(tile.column("vector").combine_chunks())
            got = scores(q, r)
            differs = label[:, None] != its_label[None, :]
            for s in np.unique(slot):
                rows = np.flatnonzero(slot == s)
                some, top = got[of[rows]], whose[2][rows][:, None]
                if some.dtype == object or top.dtype == object:
                    some, top = some.astype(object), top.astype(object)
                fits = differs[of[rows]] & (low * top <= 100 * some) & (100 * some <= high * top)
                heaps.push(some, other, fits.astype(bool), rows)
        if now is not None:
            yield from told(heaps, whose)

    def told(heaps, whose):
        if heaps is not None and len(heaps.row):
            of, positive, score = (x[heaps.row] for x in whose)
            columns = [pa.array(of), pa.array(positive), as_decimals(score), pa.array(heaps.id), as_decimals(heaps.score)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return units.mapInArrow(run, "anchor_id long, positive_id long, positive_score decimal(38,0), negative_id long, negative_score decimal(38,0)")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    window: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). is_anchor: a condition on the column id;
    label: the label of a row as an expression over vectors (else its column label); window: percents of the positive's score."""
    spark = vectors.sparkSession
    rows = blocks.staged(candidates(vectors, id_col, vector_col, label if label is not None else F.col("label")), "candidates")
    anchors = rows.where(is_anchor)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("a"), F.max(F.size("vector")).alias("d")).first()
    n_blocks = max(1, -(-size["a"] // max(64, min(ANCHORS, COMPONENTS // max(1, size["d"] or 1)))))
    n_groups = max(-(-size["n"] // GROUP), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks), 1)

    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = positives(met(anchors, rows, n_blocks, n_groups), n_positives)
    merged = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n_positives)
    held = merged.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = blocks.staged(anchors.join(held.withColumnRenamed("anchor_id", "id"), "id"), "positives")

    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = negatives(met(asked, rows, n_blocks, n_groups), n_negatives, *window)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", as_long("positive_score"), as_long("negative_score"))
