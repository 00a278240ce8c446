"""Operators on conversations and embeddings against brute force, on small tables with odd cases."""

import collections
import hashlib
import math
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, "tests")
from compare import compare, connect

from sparktab.llm import lookups, prefix_monoid, registry, rotation_codes, strassen_negatives

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_prefix_monoid", "op12_strassen_negatives", "op13_rotation_codes"])
def test_query_matches_sql(spark, name):
    assert compare(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name]) is None


def tree(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(v) - 1) * len(SPACED.findall(k[-1][1])) if k else 0
            leaves[k[:d]] += not kids[k]
    out = []
    for k, v in members.items():
        ends = ",".join(str(c) for c in sorted(v) if len(full[c]) == len(k))
        up = min(members[k[:-1]]) if k else None
        out.append((min(v), len(k), up, len(v), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turns():
    some = [(0, "a", "x y"), (1, "b", "z"), (1, "b", "z"), (None, None, None), (2, "a", "q w v\t e"), (2, "A", "q"), (3, "", "")]
    rows = [(c, *t) for c in (0, 1, 2, 3, 5, 7, 20, 21, 22, 23, 24, 45, 47, -20, -3, -7) for t in some[: (c * 5) % 8]]
    rows += [(None, 1, "a", "b"), (60, 0, "a", ""), (61, 0, "a", "x y"), (62, 5, "zz", "only"), (64, 1, "u", "w " * 20_000)]
    rows += [(c, i, "u", f"t{i % 3} k") for c in (100, 101, 105) for i in range(60)] + [(102, 7, "u", "same")] * 50
    return rows


TURNS = "conv_id long, turn long, role string, text string, conv string, part string, a string, depth string"


def of_turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], TURNS)


def prefix_tree(df):
    conv = F.col("conv")
    return prefix_monoid.prefix_tree(df, conv - conv % 20, F.crc32(conv.cast("string")) % 4, 3)


def test_prefix_tree(spark):
    rows = turns()
    got = prefix_tree(of_turns(spark, rows).repartition(5))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == tree(rows)
    assert prefix_tree(of_turns(spark, [])).collect() == []
    only = [(None, 1, "a", "b")]
    assert prefix_tree(of_turns(spark, only)).collect() == []


def test_prefix_tree_draws_other_bases_when_elements_collide(spark, monkeypatch):
    """With bases of 1 the order of turns doesn't count, so different prefixes collide; the check must see that."""
    drawn = prefix_monoid.bases
    monkeypatch.setattr(prefix_monoid, "bases", lambda attempt: [1] * 4 if attempt == 0 else drawn(attempt))
    rows = [(c, i, "u", f"t{(c * i) % 3} k") for c in (1, 2, 5, 8, 9) for i in range(4)]
    assert sorted(map(tuple, prefix_tree(of_turns(spark, rows)).collect()), key=repr) == tree(rows)


def test_sound_compares_texts(spark):
    nodes = spark.createDataFrame([(1, 2, True, False)], "x1 long, x2 long, agree boolean, one_ref boolean")
    rows = spark.createDataFrame([(1, 2, "u", "x"), (1, 2, "u", "y")], "x1 long, x2 long, role string, text string")
    assert not prefix_monoid.sound(nodes, rows)
    assert prefix_monoid.sound(nodes, rows.where("text = 'x'"))
    assert not prefix_monoid.sound(nodes.withColumn("agree", F.lit(False)), rows.limit(1))


def test_look_up_broadcasts_hot_keys_only(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") < 10_000, -1).otherwise(F.col("id") % 500).alias("k"), "id")
    table = spark.range(-1, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {r.id: r.v for r in lookups.look_up(rows, table, ["k"]).collect()}
    assert got == {i: (-2 if i < 10_000 else 2 * (i % 500) if i % 500 < 400 else None) for i in range(30_000)}


VECTORS = "vec_id long, embedding array<double>, label int, id string, node string, side string, vector string"


def of_vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], VECTORS)


def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((14, 12))
    rows = []
    for i in range(300):
        v = base[i % 14] + rng.standard_normal(12) * (0.02, 0.1, 0.4)[i % 3]
        rows.append((i * 10, (v / np.linalg.norm(v)).tolist(), int(i % 14 % 4)))
    rows += [(7000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(8000, None, 1), (8100, [0.0] * 12, 1), (8200, [float("nan")] + [1.0] * 11, 1), (8300, [float("inf")] + [1.0] * 11, 1)]
    rows += [(8400, [None] + [1.0] * 11, 1), (8500, rows[0][1], None), (8600, [], 1), (8700, [1.0, 2.0], 1), (8701, [2.0, 4.0], 1)]
    rows += [(None, rows[0][1], 0), (8800, (np.array(rows[8][1]) * 1e200).tolist(), rows[8][2]), (8801, (np.array(rows[8][1]) * 1e-200).tolist(), rows[8][2])]
    return rows


def usable(v, label):
    return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_strassen_is_exact(spark):
    rng = np.random.default_rng(0)
    for shape in ((1, 1, 1), (5, 3, 7), (77, 131, 93), (64, 64, 64)):
        a, b = rng.integers(-(1 << 20), 1 << 20, shape[:2]), rng.integers(-(1 << 20), 1 << 20, shape[1:])
        assert (strassen_negatives.strassen(a, b, 4) == a @ b).all()
    big = np.array([[1 << 80, -3]], object)
    assert strassen_negatives.strassen(np.repeat(big, 9, 0), np.repeat(big.T, 9, 1), 1)[0, 0] == (1 << 160) + 9


def mined(rows, scale=256):
    least = {}
    for i, v, label in rows:
        if i is not None and usable(v, label):
            q = [math.floor(scale * x) if abs(x) < 1e15 else int(x) * scale for x in v]
            label = (label + 1) % 10 if i % 7 == 0 else label
            least[i] = min(least.get(i, ((9, [9e300]), None, None)), ((label, v), label, q), key=lambda x: x[0])
    flat = {i: (label, q) for i, (_, label, q) in least.items()}
    cut = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for a in (i for i in flat if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(flat[a][1], q)) for i, (_, q) in flat.items()}
        order = sorted((i for i in flat if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if flat[i][0] == flat[a][0]][:5]:
            fits = [i for i in order if flat[i][0] != flat[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k + 1, i, cut(score[p]), cut(score[i])) for k, i in enumerate(fits[:5])]
    return sorted(out)


def hard_negatives(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return strassen_negatives.hard_negatives(df, F.col("id") % 100 == 0, label=label)


def test_hard_negatives(spark, monkeypatch):
    rows = [r for r in vectors() if r[0] not in (8800, 8801)]
    rows += [(9000, [0.0] * 12, 2), (9001, [0.0] * 12, 2), (9002, [0.0] * 12, 3), (9002, [0.0] * 12, 3), (9100, [0.5] * 12, 3), (9100, [0.25] * 12, 3)]
    df = of_vectors(spark, rows).repartition(3)
    assert sorted(map(tuple, hard_negatives(df).collect())) == mined(rows)
    monkeypatch.setattr(strassen_negatives, "ANCHORS", 8)
    monkeypatch.setattr(strassen_negatives, "GROUP", 50)
    monkeypatch.setattr(strassen_negatives, "TILE", 600)
    assert sorted(map(tuple, hard_negatives(df).collect())) == mined(rows)
    assert hard_negatives(of_vectors(spark, [])).collect() == []


def test_hard_negatives_beyond_64_bits(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 50, (rng.random(6) * 10.0 ** (i % 6 * 3)).tolist(), i % 3) for i in range(60)]
    assert sorted(map(tuple, hard_negatives(of_vectors(spark, rows)).collect())) == mined(rows)


def linked(rows, limit=0.98):
    n = len(rows)
    unit = []
    for i, v, label in rows:
        ok = i is not None and usable(v, label) and any(v)
        unit.append(np.array(v) / max(map(abs, v)) if ok else None)
    near = lambda a, b: unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / math.sqrt((unit[a] @ unit[a]) * (unit[b] @ unit[b])) >= limit
    links = [[b for b in range(n) if b != a and near(a, b)] for a in range(n)]
    least = [r[0] for r in rows]
    while True:
        new = [min([least[a], *(least[b] for b in links[a])]) if links[a] else least[a] for a in range(n)]
        if new == least:
            return sorted(((r[0], len(x), c, c == r[0] or c is None) for r, x, c in zip(rows, links, least)), key=repr)
        least = new


def test_near_duplicates(spark, monkeypatch):
    rows = vectors()
    rows += [rows[30], rows[30]]
    df = of_vectors(spark, rows).repartition(3)
    got = lambda: sorted(map(tuple, rotation_codes.near_duplicates(df).collect()), key=repr)
    assert got() == linked(rows)
    monkeypatch.setattr(rotation_codes, "BLOCK", 6)
    monkeypatch.setattr(rotation_codes, "PAIRS", 64)
    assert got() == linked(rows)
    assert rotation_codes.near_duplicates(of_vectors(spark, [])).collect() == []
    assert rotation_codes.near_duplicates(of_vectors(spark, rows[-12:-8])).count() == 4


@pytest.mark.parametrize("dim", [1, 2, 3, 7, 200])
def test_bounds_and_tables_lose_no_link(dim):
    """Pairs just above the limit: the bounds keep all of them, the tables all but the stated share."""
    rng = np.random.default_rng(dim)
    o = rng.standard_normal((400, dim))
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    e = rng.standard_normal((400, dim))
    e -= (e * o).sum(1, keepdims=True) * o
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
    q = 0.9800001 * o + math.sqrt(1 - 0.9800001**2) * e if dim > 1 else o * 3
    bits, tables = rotation_codes.shape(1 << 14)
    x = np.concatenate([o, q])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    signs = np.concatenate([x @ rotation_codes.rotation(dim, r) > 0 for r in range(-(-bits * tables // dim))], axis=1)[:, : bits * tables]
    keys = signs.reshape(800, tables, bits)
    assert (keys[:400] == keys[400:]).all(axis=2).any(axis=1).all()
    first = x @ rotation_codes.rotation(dim, 0)
    f = np.abs(first).sum(1) / math.sqrt(dim)
    estimate = (np.sign(first[:400]) / math.sqrt(dim) * first[400:]).sum(1)
    assert (estimate >= f[:400] * 0.98 - np.sqrt(np.maximum(0, 1 - f[:400] ** 2)) * math.sqrt(1 - 0.98**2) - 1e-6).all()
    if dim == 200:
        spread = estimate / f[:400]
        assert abs(spread.mean() - 0.98) < 0.02
