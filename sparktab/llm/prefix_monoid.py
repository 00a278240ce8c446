"""A trie of rebuilt conversations from composable fingerprints of their turns.

A rebuilt conversation is the head of a base conversation followed by the rest of its own turns. Its text is never put
together: prefixes are elements (length, four polynomial hashes, words) of a monoid,

    (l, H, w) * (m, G, v) = (l + m, H + B ** l * G, w + v)    hashes modulo the prime 2 ** 31 - 1, four bases B,

so the element of a rebuilt prefix is the base's head times what is left of an own prefix once its own head is divided
out; both are read off the stored prefixes of the two conversations.

1. Turns are put in order by ranges of (conversation, turn), so a conversation of any length is spread over tasks; each
   range stores its turns with the elements of the prefixes within the range, and the elements of whole runs, of which
   a range has two that others share, are multiplied up to carry them on.
2. Members (conversation, depth) are grouped by the prefix's element. A member refers to a stored turn; a group's
   members must agree in their parent's element and their last turn's key, and where their references differ, the texts
   behind the keys are compared. If that ever fails, everything is done again with other bases.
3. No walk over the tree is needed. The least member of a node is the least one of those of its descendants that hold
   it, so conversation c is the least member from some depth d0(c) on. A descendant counts at its least member:
   n_leaves of a node are its members that are the least one of a childless node, saved_tokens is the sum over members
   c of the words between the node's depth and d0(c).

Ids that end at a node are sorted in chunks of 65,536 numbers and hashed chunk by chunk, in order and without being
held together; SHA-256 is sequential, so the digest of one node's list is one task's work.

Defined cases: a null role or text is empty; rows with a null conversation are left out; turns are ordered null first,
ties by role, then text; repeated rows are turns of their own; a conversation whose rebuilt form has no turns belongs
to the root only; the input's other columns are ignored; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm import blocks
from sparktab.llm.lookups import look_up

WORD = r"[^\x20\x09-\x0D]+"
PRIME = (1 << 31) - 1
LANES = range(4)
#: Turns of a range; ids of a chunk, as a power of two; content keys that are sent to all tasks at most.
RANGE, CHUNK, FEW = 1 << 19, 16, 100_000
NODE = ["depth", "a", "b"]
STORED = "conv long, part int, local long, words long, x1 long, x2 long, w long, " + ", ".join(f"g{i} long, h{i} long" for i in LANES)


def bases(attempt: int) -> list[int]:
    return [int(b) for b in np.random.default_rng([11, attempt]).integers(1 << 20, PRIME - 1, len(LANES))]


def power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo PRIME."""
    out, square, left = np.ones(len(exponent), np.int64), base, exponent.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out


def ordered(turns: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, x1, x2, words) in ranges of their order, with the number of the range. Text travels only
    if two rows share conversation and turn, since nothing else needs it for the order."""
    n = turns.count()
    tied = turns.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    by = ["conv", "turn"]
    if not tied.isEmpty():
        # equal rows are told apart by where they stand, so a run of them is cut, too
        turns, by = turns.withColumn("salt", F.monotonically_increasing_id()), [*by, "role", "text", "salt"]
    n_parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // RANGE)
    rows = turns.select(*by, "x1", "x2", "words").repartitionByRange(n_parts, *by).sortWithinPartitions(*by)
    return rows.select("conv", F.spark_partition_id().alias("part"), "x1", "x2", "words")


def prefixes(rows: DataFrame, base: list[int]) -> DataFrame:
    """Each turn with its place in its range's run of the conversation, and the elements before (g) and after (h) it."""

    def run(batches):
        conv_now, length, words_now, hash_now = None, 0, 0, [0] * len(LANES)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, words, x1, x2 = (batch.column(c).to_numpy() for c in ("conv", "words", "x1", "x2"))
            start = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            run_of = np.repeat(np.arange(len(start)), np.diff([*start.tolist(), len(conv)]))
            goes_on = conv[0] == conv_now
            if not goes_on:
                length, words_now, hash_now = 0, 0, [0] * len(LANES)
            first = (run_of == 0).astype(np.int64)
            local = np.arange(len(conv)) - start[run_of] + 1 + first * length
            at_start = lambda s: (np.concatenate([[0], s[:-1]]))[start][run_of]
            total = np.cumsum(words)
            w = total - at_start(total) + first * words_now
            lanes = []
            for i, content in zip(LANES, (x1, x1 >> 31, x2, x2 >> 31)):
                step = ((content & PRIME) + 1) % PRIME * power(base[i], local) % PRIME
                total = np.cumsum(step)
                h = (total - at_start(total) + first * hash_now[i]) % PRIME
                lanes += [(h - step) % PRIME, h]
            conv_now, length, words_now, hash_now = conv[-1], int(local[-1]), int(w[-1]), [int(lanes[2 * i + 1][-1]) for i in LANES]
            names = [x.split()[0] for x in STORED.split(", ")]
            columns = [conv, batch.column("part"), local, words, x1, x2, w, *lanes]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return rows.mapInArrow(run, STORED)


def carried(stored: DataFrame, base: list[int]) -> DataFrame:
    """(conv, part, c_len, c_w, c_h0.., c_b0..): for runs that begin in an earlier range the element so far, and the bases
    to the power of its length. Only the last conversation of a range can go on, so there are fewer rows than ranges."""
    last = stored.groupBy("part").agg(F.max("conv").alias("conv")).select("conv").distinct()
    ends = [F.max("local").alias("n"), F.max("w").alias("w"), *[F.max_by(f"h{i}", "local").alias(f"h{i}") for i in LANES]]
    runs = stored.join(last, "conv", "left_semi").groupBy("conv", "part").agg(*ends)

    def run(key, table):
        rows = table.sort_by("part").to_pylist()
        n, w, h = 0, 0, [0] * len(LANES)
        out = []
        for row in rows:
            b = [pow(x, n, PRIME) for x in base]
            out.append([row["conv"], row["part"], n, w, *h, *b])
            h = [(h[i] + b[i] * row[f"h{i}"]) % PRIME for i in LANES]
            n, w = n + row["n"], w + row["w"]
        columns = list(zip(*out[1:])) or [[]] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = ["conv", "part", "c_len", "c_w", *[f"c_h{i}" for i in LANES], *[f"c_b{i}" for i in LANES]]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * (len(names) - 2)]
    schema = ", ".join(f"{c} {'int' if c == 'part' else 'long'}" for c in names)
    return runs.groupBy("conv").applyInArrow(run, schema)


def placed(stored: DataFrame, carry: DataFrame) -> DataFrame:
    """(conv, pos, words, x1, x2, w, g0.., h0..) with elements from the conversation's first turn on."""
    rows = stored.join(carry, ["conv", "part"], "left")
    some = lambda c, none: F.coalesce(F.col(c), F.lit(none).cast("long"))
    lane = lambda x, i: ((some(f"c_h{i}", 0) + some(f"c_b{i}", 1) * F.col(f"{x}{i}")) % PRIME).alias(f"{x}{i}")
    return rows.select(
        "conv", (F.col("local") + some("c_len", 0)).alias("pos"), "words", "x1", "x2", (F.col("w") + some("c_w", 0)).alias("w"),
        *[lane(x, i) for i in LANES for x in "gh"],
    )


def rebuilt(turns: DataFrame, base_of: Column, head: Column, most: int, base: list[int]) -> DataFrame:
    """(conv, h, k, n, ends_at, head, w_head, w_end, add0.., mul0..): how prefixes of the rebuilt conversation follow from its own:
    own hash * mul + add. head holds the base's first k turns."""
    turn = F.struct("pos", "words", "x1", "x2", "w", *[f"{x}{i}" for i in LANES for x in "gh"])
    firsts = [F.max(F.when(F.col("pos") == j, turn)).alias(f"t{j}") for j in range(1, most + 1)]
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n"), F.max("w").alias("w"), *firsts)
    own = convs.withColumns({"h": head.cast("int"), "base": base_of})
    its = convs.select(F.col("conv").alias("base"), F.least("n", F.lit(most)).alias("m"), F.array(*[f"t{j}" for j in range(1, most + 1)]).alias("head"))
    row = own.join(its, "base", "left")
    row = row.withColumn("k", F.least("h", F.coalesce("m", F.lit(0))).cast("int"))
    row = row.withColumn("head", F.when(F.col("k") > 0, F.slice("head", 1, F.greatest("k", F.lit(1)))))
    at = lambda which, field: F.coalesce(*[F.when(F.col("h") == j, F.col(f"t{j}.{field}")) for j in range(1, most + 1)], F.lit(0).cast("long")) if which == "own" else F.coalesce(F.element_at("head", -1)[field], F.lit(0).cast("long"))
    rest = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    inverse = lambda i: F.element_at(F.array(*[F.lit(pow(pow(base[i], -1, PRIME), e, PRIME)).cast("long") for e in range(most + 1)]), F.col("h") - F.col("k") + 1)
    row = row.withColumns({"w_head": at("head", "w") - at("own", "w"), "ends_at": F.col("k") + rest, **{f"mul{i}": inverse(i) for i in LANES}})
    row = row.withColumns({f"add{i}": F.pmod(at("head", f"h{i}") - F.col(f"mul{i}") * at("own", f"h{i}") % PRIME, F.lit(PRIME)) for i in LANES})
    w_end = F.when(rest > 0, F.col("w") + F.col("w_head")).otherwise(at("head", "w"))
    return row.select("conv", "base", "h", "k", "ends_at", "head", "w_head", w_end.alias("w_end"), *[f"{x}{i}" for i in LANES for x in ("add", "mul")])


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, a, b, pa, pb, x1, x2, words, w, ref, ref_pos, ends): each prefix of each rebuilt conversation by its element (a, b),
    its parent's, its last turn's key and the stored turn that it refers to."""
    pack = lambda x: (F.shiftleft(x[0], 31).bitwiseOR(x[1]), F.shiftleft(x[2], 31).bitwiseOR(x[3]))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    ends = (F.col("depth") == F.col("ends_at")).alias("ends")

    def row(source, depth, after, before, x1, x2, words, w, ref, ref_pos):
        (a, b), (pa_, pb) = pack(after), pack(before) if before else (none, none)
        named = dict(a=a, b=b, pa=pa_, pb=pb, x1=x1, x2=x2, words=words, w=w, ref=ref, ref_pos=ref_pos)
        return source.withColumn("depth", depth.cast("long")).select("conv", "depth", *[c.alias(k) for k, c in named.items()], ends)

    root = row(convs, zero, [zero] * 4, None, none, none, zero, zero, none, none)
    of_head = convs.select("conv", "base", "ends_at", F.explode("head").alias("t"))
    t = lambda f: F.col(f"t.{f}")
    heads = row(of_head, t("pos"), [t(f"h{i}") for i in LANES], [t(f"g{i}") for i in LANES], t("x1"), t("x2"), t("words"), t("w"), F.col("base"), t("pos"))
    own = look_up(turns, convs.drop("base", "head", "w_end"), ["conv"]).where("pos > h")
    lane = lambda x: [(F.col(f"add{i}") + F.col(f"mul{i}") * F.col(f"{x}{i}")) % PRIME for i in LANES]
    c = F.col
    rest = row(own, c("k") + c("pos") - c("h"), lane("h"), lane("g"), c("x1"), c("x2"), c("words"), c("w") + c("w_head"), c("conv"), c("pos"))
    return root.unionByName(heads).unionByName(rest)


def grouped(member: DataFrame) -> DataFrame:
    """One row for each node: its least member, number of members, parent's element, last turn, and whether its members agree."""
    both = ["pa", "pb", "x1", "x2", "words", "w"]
    agg = [F.min(c).alias(c) for c in both] + [(F.coalesce(F.min(c) == F.max(c), F.lit(True))).alias(f"one_{c}") for c in (*both, "ref", "ref_pos")]
    nodes = member.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *agg)
    agree = F.lit(True)
    for c in both:
        agree = agree & F.col(f"one_{c}")
    return nodes.select(*NODE, "conv_id", "n_convs", *both, agree.alias("agree"), (F.col("one_ref") & F.col("one_ref_pos")).alias("one_ref"))


def sound(nodes: DataFrame, rows: DataFrame) -> bool:
    """No node holds different prefixes: members agree, and one key stands for one text wherever references differ."""
    if not nodes.where("not agree").isEmpty():
        return False
    keys = nodes.where("not one_ref").select("x1", "x2").distinct()
    few = keys.limit(FEW + 1).count() <= FEW
    asked = rows.join(F.broadcast(keys), ["x1", "x2"], "left_semi") if few else rows
    texts = asked.groupBy("x1", "x2", "role", "text").agg(F.lit(1).alias("one"))
    return texts.groupBy("x1", "x2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def endings(member: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes where conversations end."""
    chunk = F.shiftright("conv", CHUNK).alias("chunk")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = member.where("ends").groupBy(*NODE, chunk).agg(ids.alias("ids"))

    def run(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for depth, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if (depth, a, b) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (depth, a, b), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*NODE, "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, digest.hexdigest())], [*NODE, "ends_sha256"])

    by_node = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return by_node.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def prefix_tree(
    conversations: DataFrame,
    base_of: Column,
    head: Column,
    most: int,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each node.
    base_of and head: the base conversation and the number of its turns to take (0 to most), as expressions over conv."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text")
    )
    rows = rows.withColumns({
        "x1": F.xxhash64("role", "text"),
        "x2": F.xxhash64(F.lit(11), "role", "text"),
        "words": F.regexp_count("text", F.lit(WORD)).cast("long"),
    })
    in_order = ordered(rows)
    attempt = 0
    while True:
        base = bases(attempt)
        stored = blocks.staged(prefixes(in_order, base), "turns")
        turns = placed(stored, blocks.staged(carried(stored, base), "carried"))
        convs = blocks.staged(rebuilt(turns, base_of, head, most, base), "rebuilt")
        member = blocks.staged(members(turns, convs), "members")
        nodes = blocks.staged(grouped(member), "nodes")
        if sound(nodes, rows):
            break
        attempt += 1

    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = blocks.staged(nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    first = nodes.groupBy("conv_id").agg(F.min(F.col("w") - F.col("words")).alias("from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    whose = convs.join(first.withColumnRenamed("conv_id", "conv"), "conv", "left").select(
        "conv", F.coalesce("from", "w_end").alias("from"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    saved = F.greatest(F.col("from") - (F.col("w") - F.col("words")), F.lit(0))
    sums = look_up(member.select("conv", *NODE, "w", "words"), whose, ["conv"]).groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens")
    )
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    rest = look_up(nodes.where("depth > 0"), parent, ["depth", "pa", "pb"])
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    full = rest.unionByName(top).join(sums, NODE).join(endings(member), NODE, "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
