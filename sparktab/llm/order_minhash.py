"""Near-duplicate classes by order min-hash.

A document is the sequence of its shingles (five lower-cased words), each labelled with how
often it came before, so that repeats count. Order min-hash draws, for each of BANDS hash
functions, the TAKE shingles of least hash and keeps them in the order of the text; two
documents meet in a band if they drew the same shingles in the same order. Reordered texts
with equal shingles do not meet, which is what makes the sketch follow edit similarity.
Texts of at most TAKE shingles draw them all, so in place of bands they have exact keys: the
whole sequence, and the sequence without each one of its shingles, which is all that
SIMILARITY lets two of them differ by. Texts of at most SHORT shingles have FEW_BANDS bands
more that draw FEW shingles, as eight common minima are rare where few shingles are common.

Candidates are verified by banded alignment of the shingle sequences: with m shingles
aligned in order, the similarity is m / (n1 + n2 - m), and documents at SIMILARITY or more
are linked. The band is as wide as the unaligned shingles that this allows. Documents with
the same words need no sketch of their own; linked documents form a class (transitively).

No step gathers a bucket. Buckets are runs of equal keys in a table sorted by range, which
may cut a hot bucket anywhere; the parts are tied by their last and first rows. Within a run
the documents are sorted by four further minima, which puts the most similar next to each other, and each is paired with its
neighbour and with the first of the run: two candidates a row, not all pairs. A cluster of
n documents so gets up to 2 * BANDS * n differently ordered candidates. They are verified in
two turns, one for each document first, then those between documents that the first turn
did not join. The third turn tries what is left: every pair that meets in a run and is in
two classes, unless a bound says that too few shingles can be aligned. Shingles that no
other class has cannot be; of the rest no more than the lesser count in each part of the
hash space. So each pair that shares a band is joined, verified or ruled out.

Defined cases: a text of fewer than five words is one shingle; texts without words are
copies only of equal texts; null is the empty text; a null id counts as a document with no
id, whose class is named by the other ids (null if there are none); rows with one id are
one document if their words agree, else they share a class; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm import blocks, words
from sparktab.llm.huffman import in_runs
from sparktab.session import cut_lineage, drop_finished_shuffles, release

SHINGLE, BANDS, TAKE, SIMILARITY = 5, 40, 8, 0.8
SHORT, FEW_BANDS, FEW = 64, 16, 3
SLICE = 1 << 14
SALTS, PARTS = 8, 64
TEXT_RUN = 2 << 20

_RANDOM = words.mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
SKETCH = "id long, node long, seq_a long, seq_b long, near long, keys array<long>"


def shingles(word_hashes: np.ndarray) -> np.ndarray:
    """The shingle sequence of one document."""
    if not len(word_hashes):
        return word_hashes
    return words.grams(word_hashes, min(SHINGLE, len(word_hashes)))


def labelled(grams: np.ndarray) -> np.ndarray:
    """Each shingle with its number among equal ones of the document."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    nth = np.empty(len(grams), np.uint64)
    nth[order] = np.arange(len(grams)) - np.repeat(heads, np.diff(np.append(heads, len(grams))))
    return words.mix(grams + nth * np.uint64(0x9E3779B97F4A7C15))


def sketch(labels: np.ndarray, bands: int = BANDS, take: int = TAKE) -> tuple[np.ndarray, int]:
    """The key of each band, and one number that sorts similar documents next to each other."""
    factors = _RANDOM[: bands + 4] | np.uint64(1)
    picked = np.zeros((0, bands + 4), np.int64)
    for low in range(0, len(labels), SLICE):  # bounded memory: the least of each slice, then the least of those
        rows = np.concatenate([picked, np.broadcast_to(np.arange(low, min(low + SLICE, len(labels)))[:, None], (min(SLICE, len(labels) - low), bands + 4))])
        values = labels[rows] * factors
        if len(rows) > take:
            rows = np.take_along_axis(rows, np.argpartition(values, take, axis=0)[:take], axis=0)
        picked = rows
    values = labels[picked[:, bands:]] * factors[bands:]
    near = 0
    for column in range(4):
        near = near << 16 | int(values[:, column].min() >> np.uint64(48))
    in_order = labels[np.sort(picked[:, :bands], axis=0)]
    return _folded(in_order, np.arange(1, bands + 1, dtype=np.uint64)), near - (1 << 63)


def _folded(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    for row in rows:
        keys = keys * np.uint64(0xD1342543DE82EF95) + row
    return words.mix(keys)


def short_keys(grams: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The further keys of a text of at most SHORT shingles; with at most TAKE they replace those of sketch()."""
    n = len(grams)
    if n > SHORT:
        return np.zeros(0, np.uint64)
    factors = _RANDOM[BANDS + 4 : BANDS + 4 + FEW_BANDS] | np.uint64(1)
    least = np.argsort(labels[:, None] * factors, axis=0)[:FEW]
    keys = [_folded(labels[np.sort(least, axis=0)], np.arange(BANDS + 1, BANDS + FEW_BANDS + 1, dtype=np.uint64))]
    if n <= TAKE:
        keys.append(_folded(grams[:, None], np.zeros(1, np.uint64)))
        if n - 1 >= SIMILARITY * n:
            at = np.arange(n - 1)[:, None]
            keys.append(_folded(grams[at + (at >= np.arange(n))], np.zeros(n, np.uint64)))
    return np.unique(np.concatenate(keys))


def keys_of(grams: np.ndarray) -> tuple[np.ndarray, int]:
    """All keys under which a text with these shingles meets others, and the number of sketch()."""
    labels = labelled(grams)
    keys, near = sketch(labels)
    return np.concatenate([keys[:0] if len(grams) <= TAKE else keys, short_keys(grams, labels)]), near


def _word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = words.buffer_of(text)
    data = words.LOWER[data]
    starts, ends, first = words.spans(data, offsets, words.ALNUM)
    return words.hashes(data, starts, ends), first


def sketches(rows: DataFrame) -> DataFrame:
    """One row per row of rows (id, text); node: the id, or a number below all ids where it is null."""

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            text = text.fill_null("") if text.null_count else text
            for low, high in in_runs(np.diff(words.buffer_of(text)[1]).tolist(), TEXT_RUN):
                part = text[low:high]
                word, first = _word_hashes(part)
                ids = batch.column("id")[low:high].to_pylist()
                out = []
                for i, doc_id in enumerate(ids):
                    own = word[first[i] : first[i + 1]]
                    if len(own):
                        keys, near = keys_of(shingles(own))
                        seq = [words.grams(own, len(own), s)[0] if len(own) <= 64 else _long_hash(own, s) for s in (2, 3)]
                    else:
                        raw = words.buffer_of(part[i : i + 1])[0]
                        whole = words.hashes(raw, np.zeros(1, np.int64), np.array([len(raw)])) if len(raw) else np.zeros(1, np.uint64)
                        keys, near, seq = np.zeros(0, np.uint64), 0, [whole[0], np.uint64(len(raw))]
                    a, b = (int(np.uint64(x).view(np.int64)) for x in seq)
                    node = doc_id if doc_id is not None else -(1 << 62) - (a >> 2 & (1 << 61) - 1)
                    out.append((doc_id, node, a, b, near, keys.view(np.int64)))
                types = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in SKETCH.split(", ")])

    return rows.mapInArrow(run, SKETCH)


def _long_hash(word_hashes: np.ndarray, seed: int) -> np.uint64:
    base = np.uint64(0x9FB21C651E98DF25 if seed == 2 else 0xD6E8FEB86659FD93)
    power = np.cumprod(np.full(len(word_hashes), base, np.uint64))
    return words.mix(np.array([(word_hashes * power).sum() + np.uint64(len(word_hashes))], np.uint64))[0]


def candidates(representatives: DataFrame) -> DataFrame:
    """Pairs (a < b) of neighbours, and of first and member, in the runs of equal keys. Where a partition ends within a run
    its part is a run of its own, and the pairs over the border are added: each partition says what it begins and ends with."""
    met = representatives.select(F.explode("keys").alias("key"), "near", "node")
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["a", "b", "part", "key"]

    def run(batches):
        key, first, last, border = None, None, None, None
        for batch in batches:
            keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            if not len(keys):
                continue
            border = border or (int(keys[0]), int(nodes[0]))
            new = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
            heads = np.flatnonzero(new)
            start = np.where(np.arange(len(keys)) >= (heads[0] if len(heads) else len(keys)), 0, -1)
            start[start == 0] = np.repeat(heads, np.diff(np.append(heads, len(keys))))
            begin = np.where(start >= 0, nodes[np.maximum(start, 0)], first if first is not None else nodes[0])
            previous = np.concatenate([[last if last is not None else nodes[0]], nodes[:-1]])
            a, b = np.concatenate([previous[~new], begin[~new]]), np.concatenate([nodes[~new], nodes[~new]])
            differ = a != b
            a, b = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
            key, first, last = keys[-1], begin[-1], nodes[-1]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64())], names)
        if border:
            at = TaskContext.get().partitionId()
            columns = [[border[1], first], [None, last], [at, at], [border[0], key]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names)

    dealt = met.repartitionByRange(parts, "key", "near", "node").sortWithinPartitions("key", "near", "node")
    found = cut_lineage(dealt.mapInArrow(run, "a long, b long, part int, key long").distinct())
    over = across(found.where("part is not null").collect())
    return found.where("part is null").select("a", "b").unionByName(met.sparkSession.createDataFrame(over, "a long, b long"))


def across(borders: list) -> list[tuple[int, int]]:
    """The pairs of neighbours, and of first and member, that the borders of partitions cut apart. Two rows a partition:
    (key, a: the first node, b: null), and (key, a: the first node of the last run, b: the last node)."""
    out, before = set(), None
    for row in sorted(borders, key=lambda r: (r["part"], r["b"] is not None)):
        if row["b"] is None:
            if before is not None and before["key"] == row["key"]:
                out |= {(min(x, row["a"]), max(x, row["a"])) for x in (before["a"], before["b"]) if x != row["a"]}
        else:
            before = row
    return sorted(out)


def aligned(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences by banded alignment; 0 if it cannot reach least."""
    n = len(x) + len(y)
    need = int(np.ceil(least * n / (1 + least) - 1e-9))
    if min(len(x), len(y)) < need:
        return 0.0
    band = n - 2 * need
    same = x[: len(y)] == y[: len(x)]
    head = len(same) if same.all() else int(same.argmin())
    x, y = x[head:], y[head:]
    k = min(len(x), len(y))
    same = x[len(x) - k :][::-1] == y[len(y) - k :][::-1]
    tail = k if same.all() else int(same.argmin())
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    matched = head + tail
    if len(x) and len(y):
        if matched + len(np.intersect1d(x, y)) < need and len(np.unique(x)) == len(x):
            return 0.0
        matched += _banded(x.tolist(), y.tolist(), band)
    return matched / (n - matched) if matched >= need else 0.0


def _banded(x: list[int], y: list[int], band: int) -> int:
    """Length of the longest common subsequence with places at most band apart, by bits over x for each of y."""
    where: dict[int, int] = {}
    for i, value in enumerate(x):
        where[value] = where.get(value, 0) | 1 << i
    every = (1 << len(x)) - 1
    window = (1 << 2 * band + 1) - 1
    row = every
    for j, value in enumerate(y):
        hits = where.get(value, 0)
        if hits:
            hits &= window << j - band if j >= band else window >> band - j
            taken = row & hits
            row = (row + taken | row - taken) & every
    return len(x) - row.bit_count()


def linked(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sequences align; sequences: rows (node, shingles)."""

    def run(batches):
        for batch in batches:
            keep = [
                aligned(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= SIMILARITY
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            ]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    left = pairs.join(sequences.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = left.join(sequences.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, class): the least node that links lead to, for every node of edges. Alternates large-star and small-star
    rounds; each is a grouped minimum and a join, and is checkpointed. The rounds before it are released. known: the
    classes (node, class) of links found before, which count as links of their own; they alone are final."""
    new = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    if known is not None:
        new = cut_lineage(new)
        if new.isEmpty():
            release(new)
            return known
        stars = known.where("node <> class").select(F.col("node").alias("a"), F.col("class").alias("b"))
        now = cut_lineage(new.unionByName(stars).distinct())
        release(new)
    else:
        now = cut_lineage(new)
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        done, now = now, cut_lineage(small.where("a <> b").distinct())
        del both, least, large, joined, small
        release(done)
    return now.groupBy("a").agg(F.min("b").alias("class")).withColumnRenamed("a", "node").unionByName(
        now.groupBy("b").agg(F.first("b").alias("class")).withColumnRenamed("b", "node")
    )


def unsettled(representatives: DataFrame, open_pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node, class, most): the runs that hold more than one class, with most, the largest class of each. Such a run
    has neighbours of different classes, so its key is among those that a pair of open_pairs shares."""
    keys = representatives.select("node", "keys")
    both = open_pairs.join(keys.select(F.col("node").alias("a"), F.col("keys").alias("x")), "a")
    both = both.join(keys.select(F.col("node").alias("b"), F.col("keys").alias("y")), "b")
    shared = both.select(F.explode(F.array_intersect("x", "y")).alias("key")).distinct()
    met = representatives.select(F.explode("keys").alias("key"), "node").join(shared, "key", "left_semi")
    named = cut_lineage(met.join(classes, "node", "left").select("key", "node", F.coalesce("class", "node").alias("class")))
    counts = named.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(mixed.drop("n"), "key")


def alignable(sequences: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, n, at_most, parts): of each sequence the shingles, and how many of them stand in a sequence of another class,
    which is the most that can be aligned with one, in all and in each of PARTS parts of the hash space. Sequences for
    which that is too few for any partner are left out."""

    def run(batches):
        for batch in batches:
            for node, own_class, packed in zip(*(batch.column(c).to_pylist() for c in ("node", "class", "shingles"))):
                own = labelled(np.frombuffer(packed, "<u4").astype(np.uint64)).view(np.int64)
                text = int(words.mix(np.array([own.view(np.uint64).sum() + np.uint64(len(own))], np.uint64)).view(np.int64)[0])
                columns = [pa.array(np.full(len(own), x, np.int64)) for x in (node, own_class, text, len(own))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own)], ["node", "class", "text", "n", "label"])

    labels = sequences.join(classes, "node").select("node", "class", "shingles").mapInArrow(run, "node long, class long, text long, n long, label long")
    elsewhere = labels.groupBy("label").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("label")
    part = F.pmod("label", F.lit(PARTS)).cast("int")
    held = labels.join(elsewhere, "label").groupBy("node", "text", "n").agg(F.collect_list(part).alias("parts"))

    def count(batches):
        for batch in batches:
            made = [np.bincount(x, minlength=PARTS) for x in batch.column("parts").to_pylist()]
            columns = [batch.column("node"), batch.column("n"), pa.array([int(x.sum()) for x in made], pa.int64()), pa.array(made, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "at_most", "parts"])

    counted = held.mapInArrow(count, "node long, n long, at_most long, parts array<int>")
    return counted.where(F.col("at_most") >= SIMILARITY * F.col("n") - 1e-9)


def rest(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """The pairs (a < b) of different classes in one run that may align at SIMILARITY: no more can be aligned than the
    lesser of the two counts in each part. Members of a run's largest class
    are paired with those of other classes only, and a run is dealt over SALTS tasks."""
    row = runs.join(bounds, "node")
    left = row.where("class <> most").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("x")
    right = row.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).alias("y")
    need = SIMILARITY / (1 + SIMILARITY) * (F.col("x.n") + F.col("y.n")) - 1e-9
    both = F.aggregate(F.zip_with("x.parts", "y.parts", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda a, b: a + b)
    fits = (F.col("x.class") != F.col("y.class")) & (F.least("x.at_most", "y.at_most") >= need) & (both >= need)
    met = left.join(right, (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & fits)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id (the least id of its class), class_size (rows), kept (it is the one that
    stays: the row whose id names the class)."""
    rows = blocks.documents(docs, id_col, text_col)
    drawn = blocks.staged(sketches(rows), "order-minhash")
    same = drawn.groupBy("seq_a", "seq_b").agg(F.min("node").alias("rep"))
    found = drawn.select("seq_a", "seq_b", "node", "near", "keys").join(same, ["seq_a", "seq_b"]).where("node = rep")
    representatives = blocks.staged(found.where("size(keys) > 0").dropDuplicates(["node", "seq_a", "seq_b"]).select("node", "near", "keys"), "representatives")
    pairs = candidates(representatives)
    drop_finished_shuffles(docs.sparkSession)  # those of the sketches, and of the jobs that made docs
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    with_node = rows.join(wanted.withColumnRenamed("node", "id"), "id").unionByName(_without_id(rows, wanted))
    sequences = blocks.staged(_sequences(with_node), "shingles")
    drop_finished_shuffles(docs.sparkSession)
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    sure = cut_lineage(linked(first, sequences))
    joined = cut_lineage(components(sure))
    release(sure)
    at = lambda c, known: known.select(F.col("node").alias(c), F.col("class").alias(f"{c}_class"))
    apart = lambda some, known: (
        some.join(at("a", known), "a", "left").join(at("b", known), "b", "left").where("coalesce(a_class, a) <> coalesce(b_class, b)").select("a", "b")
    )
    untried = pairs.join(first, ["a", "b"], "left_anti")
    sure = cut_lineage(linked(apart(untried, joined), sequences))
    once, joined = joined, cut_lineage(components(sure, joined))
    release(sure, once)
    runs = cut_lineage(unsettled(representatives, apart(pairs, joined), joined))
    left = rest(runs, alignable(sequences, runs.select("node", "class").distinct()))
    sure = cut_lineage(linked(cut_lineage(left.join(pairs, ["a", "b"], "left_anti")), sequences))
    release(runs)
    classes = components(sure, joined)
    named = same.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("seq_a", "seq_b", F.coalesce("class", "rep").alias("class"))
    members = cut_lineage(drawn.select("id", "node", "seq_a", "seq_b").join(named, ["seq_a", "seq_b"]).select("id", "node", "class"))
    sizes = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return members.join(sizes, "class").select(
        "id", "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def _without_id(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows with a null id under the node that sketches() gives them."""
    nulls = rows.where("id is null")
    drawn = sketches(nulls).select("node")
    return nulls.limit(0) if drawn.isEmpty() else _numbered(nulls).join(wanted.withColumnRenamed("node", "id"), "id", "left_semi")


def _numbered(nulls: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column("text")[i : i + 1].fill_null("")
                own = _word_hashes(part)[0]
                if len(own):
                    a = int(np.uint64(words.grams(own, len(own), 2)[0] if len(own) <= 64 else _long_hash(own, 2)).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([-(1 << 62) - (a >> 2 & (1 << 61) - 1)]), part], ["id", "text"])

    return nulls.mapInArrow(run, "id long, text string")


def _sequences(rows: DataFrame) -> DataFrame:
    """(node, shingles): the shingle sequence of each row (id, text), 32 bits a shingle."""

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            text = text.fill_null("") if text.null_count else text
            for low, high in in_runs(np.diff(words.buffer_of(text)[1]).tolist(), TEXT_RUN):
                word, first = _word_hashes(text[low:high])
                packed = [(shingles(word[s:e]) >> np.uint64(32)).astype("<u4").tobytes() for s, e in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id")[low:high], pa.array(packed, pa.binary())], ["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles binary")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one for each class, with all their columns. Rows that share an id stay or go
    together; rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col).where("id is not null and not kept").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
