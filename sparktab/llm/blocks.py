"""Blocks of documents, and questions from blocks to a key space that is spread over buckets.

Several operators ask something about every word sequence of every document (how often
does it occur, does an earlier document have it). One row per sequence would cost several
times the text in shuffles. Instead the documents are dealt into blocks by the hash of
their id and text; each block sends every bucket of the key space one row with its distinct keys,
packed, and gets one packed row of answers back. Keys that are frequent are combined in
the blocks, so no bucket sees more than one copy of a key per block. The shuffle that
deals the blocks is written once: both uses in the plan share it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.session import scratch_path

BLOCK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20
MIN_BUCKETS = 64
MAX_PARTITIONS = 100_000

QUESTION = "bucket int, block long, n int, keys binary, extra binary"
ANSWER = "block long, bucket int, n int, reply binary"


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id (long) and the text of all rows under names of our own; other columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def sizes(rows: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of text."""
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(got["n"]), int(got["b"] or 0)


def deal(rows: DataFrame, n_bytes: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (id, text) with their block, all rows of a block in one partition. A block holds about block_bytes of
    text, more only if one text alone is longer or a row repeats with its id."""
    n_blocks = max(1, -(-n_bytes // block_bytes))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).alias("block")
    return rows.select(block, "id", "text").repartition(min(n_blocks, MAX_PARTITIONS), "block")


def bucket_count(n_keys: int, bucket_keys: int = BUCKET_KEYS) -> int:
    return max(MIN_BUCKETS, -(-n_keys // bucket_keys))


def ordered(table: pa.Table) -> pa.Table:
    """Documents of a block by id (nulls first), then text: the same order however the shuffle delivered them."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")], null_placement="at_start") if table.num_rows > 1 else table


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The blocks of a partition sorted by block, one at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            if held and blocks[low] != now:
                yield now, ordered(pa.Table.from_batches(held).select(["id", "text"]))
                held = []
            now = int(blocks[low])
            held.append(batch.slice(low, high - low))
    if held:
        yield now, ordered(pa.Table.from_batches(held).select(["id", "text"]))


def ids_of(table: pa.Table) -> np.ndarray:
    """Ids as numbers; a null id counts as below every id."""
    column = table.column("id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)


def ask(dealt: DataFrame, questions: Callable[[int, pa.Table], Iterator[tuple]]) -> DataFrame:
    """One row (bucket, block, n, keys, extra) for each bucket a block has keys for."""
    names = [x.split()[0] for x in QUESTION.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        for block, table in in_blocks(batches):
            rows = list(questions(block, table))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return dealt.sortWithinPartitions("block").mapInArrow(run, QUESTION)


def by_bucket(bucket: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The indexes of each bucket's keys, in their own order."""
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32
    order = np.argsort(bucket.astype(kind), kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n_buckets))])
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def answer(asked: DataFrame, n_buckets: int, reply: Callable[[list[dict]], Iterator[tuple]]) -> DataFrame:
    """reply gets the rows of one bucket and gives rows (block, bucket, n, reply). A partition holds a bucket or a
    few, so at most a few times BUCKET_KEYS keys, besides one more for each block that shares a key."""
    names = [x.split()[0] for x in ANSWER.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["bucket"], []).append(row)
        for bucket in sorted(held):
            rows = list(reply(held.pop(bucket)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return asked.repartition(min(n_buckets, MAX_PARTITIONS), "bucket").mapInArrow(run, ANSWER)


def meet(dealt: DataFrame, answered: DataFrame, finish: Callable[[int, pa.Table, dict], pa.Table], schema: str) -> DataFrame:
    """finish gets each block's documents, ordered, with its answers {bucket: (n, reply)}."""

    def run(key, left, right):
        block = key[0].as_py()
        replies = {b: (n, r) for b, n, r in zip(*(right.column(c).to_pylist() for c in ("bucket", "n", "reply")))}
        return finish(block, ordered(left.select(["id", "text"])), replies)

    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: survives lost executors, is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
