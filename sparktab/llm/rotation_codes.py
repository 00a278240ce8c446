"""Near-duplicate embeddings: binary codes of randomly rotated vectors decide which pairs are recomputed.

1. Equal vectors of a label become one node with a count.
2. A node's unit vector o is turned by random rotations; the signs of its coordinates are its code. For the first
   rotation the node stores the correction factor f = <x, o>, where x is the unit vector of the signs, and o itself in
   8-bit steps (o8) with the length of what the steps lose.
3. BITS bits at a time of the codes are bucket keys: nodes are compared where one key at least is the same. The number
   of tables is such that a pair just at the limit shares no key with probability MISS at most, closer ones with less.
4. In a bucket <x, o8'> / f estimates the inner product of two nodes without bias. As o' = cos a * o + sin a * e with
   e at right angles to o, and |<x, e>| <= sqrt(1 - f * f), a pair within the limit has an estimate of at least
   cos a - sin a * sqrt(1 - f * f) / f - loss / f. This bound has confidence one: it never rules a link out. Pairs that
   share several keys are judged in the first table where they do.
5. Only nodes with a pair that both bounds leave open get their vectors sent to the bucket, where the cosine of the
   open pairs is taken in double precision. A bucket gives each node's number of links and the least node that it is
   joined to; pairs are never rows.

Buckets of more than BLOCK nodes are cut into blocks, and every two blocks meet in a task of their own. Nodes that are
near to each other and not equal are compared one by one, since a count of links needs it: a group of m of them costs
m * m / 2 estimates, spread over the blocks, and m rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, rows with a null label and
rows with a null id link with nothing (n_links 0, component_id their own id); vectors of different lengths do not
link; rows that repeat with id, label and vector each count as a vector; the input's other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm import blocks
from sparktab.llm.lookups import look_up
from sparktab.llm.order_minhash import components
from sparktab.session import cut_lineage

COSINE = 0.98
#: Greatest probability that a pair just at the limit shares no key.
MISS = 1e-6
#: Nodes of the largest label that a bucket holds on average, as a power of two.
BUCKET_BITS = 7
BLOCK = 4096
#: Pairs whose codes are compared at once.
PAIRS = 1 << 18
SLACK = 1e-4
UNIT = ["label", "dim", "t", "key", "i", "j"]
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def usable(vector: Column) -> Column:
    """The vector can link: finite components, one of them not zero."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine & F.exists(x, lambda c: c != 0), F.lit(False))


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    if (dim, number) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
        _ROTATIONS[dim, number] = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    return _ROTATIONS[dim, number]


def shape(most: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of tables for labels of at most so many nodes."""
    bits = max(4, math.ceil(math.log2(max(most, 1))) - BUCKET_BITS)
    same = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(miss) / math.log1p(-(same**bits)))


def matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of a list column by length: their indexes and their rows as doubles. No lists or components are null."""
    size = np.diff(column.offsets.to_numpy())
    start = column.offsets.to_numpy()[:-1]
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield at, values[start[at][:, None] + np.arange(dim)]


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that no square overflows or vanishes; exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def coded(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, label, n, dim, keys, code, o8, step, f, loss) of nodes (node, label, vector, n)."""

    def run(batches):
        for batch in batches:
            for at, x in matrix(batch.column("vector")):
                dim = x.shape[1]
                x = scaled(x)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                first = x @ rotation(dim, 0)
                signs = np.concatenate([x @ rotation(dim, r) > 0 if r else first > 0 for r in range(-(-bits * tables // dim))], axis=1)
                f = np.abs(first).sum(axis=1) / math.sqrt(dim)
                step = np.abs(first).max(axis=1) / 127
                o8 = np.rint(first / step[:, None]).astype(np.int8)
                loss = np.sqrt(((first - o8 * step[:, None]) ** 2).sum(axis=1))
                # the first rotation's signs give the estimates, so at least these are kept
                kept = signs[:, : max(dim, bits * tables)]
                keys = signs[:, : bits * tables].reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                packed = np.packbits(kept, axis=1)
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("node"),
                        own.column("label"),
                        own.column("n"),
                        pa.array(np.full(len(x), dim, np.int32)),
                        pa.array(keys.tolist(), pa.list_(pa.int64())),
                        pa.array([p.tobytes() for p in packed], pa.binary()),
                        pa.array([o.tobytes() for o in o8], pa.binary()),
                        pa.array(step),
                        pa.array(f),
                        pa.array(loss),
                    ],
                    ["node", "label", "n", "dim", "keys", "code", "o8", "step", "f", "loss"],
                )

    label = nodes.schema["label"].dataType.simpleString()
    schema = f"node long, label {label}, n long, dim int, keys array<long>, code binary, o8 binary, step double, f double, loss double"
    return nodes.select("node", "label", "vector", "n").mapInArrow(run, schema)


def in_units(codes: DataFrame) -> DataFrame:
    """Rows of codes once for each table and each block that their own is compared with: with t, key, i, j and block."""
    row = codes.select("*", F.posexplode("keys").alias("t", "key")).drop("keys")
    bucket = ["label", "dim", "t", "key"]
    count = F.count(F.lit(1))
    cut = cut_lineage(row.groupBy(*bucket).agg(count.alias("m")).where(F.col("m") > BLOCK).withColumn("cuts", F.ceil(F.col("m") / BLOCK).cast("int")))
    hot = cut.drop("m")
    if hot.isEmpty():
        zero = F.lit(0)
        return row.withColumns({"block": zero, "i": zero, "j": zero})
    # at most one cut bucket for BLOCK rows; sent to all tasks only while it is a few thousand rows
    row = row.join(F.broadcast(hot) if hot.count() <= 10_000 else hot, bucket, "left")
    cuts = F.coalesce("cuts", F.lit(1))
    row = row.withColumn("block", F.pmod(F.xxhash64("node"), cuts).cast("int"))
    row = row.withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    return row.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("cuts", "other")


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit of a partition sorted by unit, one unit at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in UNIT]
        new = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            at = tuple(c[low] for c in columns)
            if held and at != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = at
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bytes_of(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, -1)


def open_pairs(unit: pa.Table, bits: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a unit, each once, that the bounds leave open and that share no key of an earlier table."""
    dim, t, i, j = (unit.column(c)[0].as_py() for c in ("dim", "t", "i", "j"))
    block = unit.column("block").to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    code = np.unpackbits(bytes_of(unit, "code", np.uint8), axis=1)
    x = ((code[:, :dim].astype(np.float32) * 2 - 1) / math.sqrt(dim)).astype(np.float32)
    o = bytes_of(unit, "o8", np.int8) * unit.column("step").to_numpy().astype(np.float32)[:, None]
    f, loss = unit.column("f").to_numpy(), unit.column("loss").to_numpy()
    # least estimate of a link, times f, but for the other one's loss
    least = (f * cosine - np.sqrt(np.maximum(0, 1 - f * f)) * math.sqrt(1 - cosine * cosine) - SLACK).astype(np.float32)
    early = code[:, : t * bits]
    some = max(1, PAIRS // max(len(right), 1))
    for low in range(0, len(left), some):
        a = left[low : low + some]
        fits = x[a] @ o[right].T >= least[a][:, None] - loss[right].astype(np.float32)[None, :]
        fits &= o[a] @ x[right].T >= least[right][None, :] - loss[a].astype(np.float32)[:, None]
        if i == j:
            fits &= a[:, None] < right[None, :]
        p, q = np.nonzero(fits)
        p, q = a[p], right[q]
        if t and len(p):
            apart = (early[p] != early[q]).reshape(len(p), t, bits).any(axis=2).all(axis=1)
            p, q = p[apart], q[apart]
        if len(p):
            yield p, q


def wanted(units: DataFrame, bits: int, cosine: float) -> DataFrame:
    """The rows of units that have an open pair there."""
    names = units.columns

    def run(batches):
        for unit in by_unit(batches):
            if unit.num_rows < 2:
                continue
            hit = np.zeros(unit.num_rows, bool)
            for p, q in open_pairs(unit, bits, cosine):
                hit[p] = hit[q] = True
            if hit.any():
                yield from unit.filter(pa.array(hit)).select(names).to_batches()

    return units.mapInArrow(run, units.schema)


def joined(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n points the least one that the pairs (p, q) lead to."""
    least = np.arange(n)
    while True:
        m = np.minimum(least[p], least[q])
        before = least.copy()
        np.minimum.at(least, p, m)
        np.minimum.at(least, q, m)
        least = least[least]
        if (least == before).all():
            return least


def recomputed(units: DataFrame, bits: int, cosine: float) -> DataFrame:
    """(node, links, least): what a node's unit adds to its links, copies counted, and a node that it is joined to."""

    def run(batches):
        for unit in by_unit(batches):
            unit = unit.sort_by("node")
            (_, v), *_ = matrix(unit.column("vector").combine_chunks())
            v = scaled(v)
            norm = np.sqrt((v * v).sum(axis=1))
            n, node = unit.column("n").to_numpy(), unit.column("node").to_numpy()
            links = np.zeros(len(node), np.int64)
            found = []
            for p, q in open_pairs(unit, bits, cosine):
                for low in range(0, len(p), PAIRS // 8):
                    a, b = p[low : low + PAIRS // 8], q[low : low + PAIRS // 8]
                    near = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b]) >= cosine
                    a, b = a[near], b[near]
                    np.add.at(links, a, n[b])
                    np.add.at(links, b, n[a])
                    least = joined(len(node), a, b)
                    moved = np.flatnonzero(least != np.arange(len(node)))
                    found.append((moved, least[moved]))
            if links.any():
                p, q = (np.concatenate(x) for x in zip(*found))
                hit = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[hit]), pa.array(links[hit]), pa.array(node[joined(len(node), p, q)][hit])], ["node", "links", "least"]
                )

    return units.mapInArrow(run, "node long, links long, least long")


def dealt(units: DataFrame, n_parts: int) -> DataFrame:
    return units.repartition(n_parts, *UNIT).sortWithinPartitions(*UNIT)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """One row per row of vectors: id, n_links (rows of the same label at cosine or more), component_id (the least id
    that links lead to), kept (that is its own). cosine must be above 0.9."""
    if not 0.9 < cosine < 1:
        raise ValueError("codes of signs tell pairs apart at a cosine above 0.9 only")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    apart = ~(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    alone = rows.where(apart).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where(~apart)
    groups = rows.groupBy("label", "vector").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    # written with its numbers, so that they stay when a task runs again
    nodes = blocks.staged(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")
    most = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0]
    if most is None:
        return alone
    bits, tables = shape(most, cosine, miss)
    codes = blocks.staged(coded(nodes, bits, tables), "codes")
    units = in_units(codes)
    size = nodes.count()
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size * tables // 100_000)
    near = blocks.staged(wanted(dealt(units, n_parts), bits, cosine), "open")
    fetched = near.join(nodes.select("node", "vector"), "node")
    found = cut_lineage(recomputed(dealt(fetched, n_parts), bits, cosine))
    classes = components(found.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    named = cut_lineage(nodes.select("node", "least_id").join(classes, "node"))
    least = named.groupBy("class").agg(F.min("least_id").alias("component_id"))
    member = look_up(named.select("node", "class"), least, ["class"]).select("node", "component_id")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.join(links, "node", "left").join(member, "node", "left").select(
        "label",
        "vector",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "least_id").alias("component_id"),
    )
    got = look_up(rows, told, ["label", "vector"])
    return got.select("id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")).unionByName(alone)
