"""Exact, repeatable stratified hold-out and folds.

Rows of a class are ordered by a seeded hash of their id. A side of the split is a
rank range of that order, so it is decided by comparing each row with a few marks per
class: the table itself is neither sorted nor shuffled. The marks are found by
counting hash prefixes and ranking only the rows that share a mark's prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 4


def order_key(row_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))


def test_counts(counts: dict, test_size: float) -> dict:
    """Test rows per class: proportional, largest remainders first, exact in total."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    if not 0 < n_test < n:
        raise ValueError("Train/test split failed: empty train or test set.")
    if min(counts.values()) < 2:
        raise ValueError("The least populated class needs at least 2 rows.")
    if min(n_test, n_train) < len(counts):
        raise ValueError("Each side of the split needs at least one row per class.")
    train = {c: k * n_train // n for c, k in counts.items()}
    by_remainder = sorted(counts, key=lambda c: (-(counts[c] * n_train % n), c))
    for c in by_remainder[: n_train - sum(train.values())]:
        train[c] += 1
    return {c: counts[c] - train[c] for c in counts}


def fold_counts(counts: dict, folds: int) -> dict:
    """Rows of each class in each fold, as if classes were dealt out one after another."""
    if folds < 2 or all(k < folds for k in counts.values()):
        raise ValueError(f"Cannot make {folds} folds from these class counts.")
    sizes, start = {}, 0
    for c, k in counts.items():
        sizes[c] = [len(range((f - start) % folds, k, folds)) for f in range(folds)]
        start += k
    return sizes


def rank_marks(df: DataFrame, label: str, row_id: str, seed: int, cuts: dict) -> DataFrame:
    """(label, marks): for each class the keys of the rows at the wanted ranks.

    ``cuts`` maps a class to ascending ranks; rank 0 gives a mark below every key.
    The result has one row per class.
    """
    spark = df.sparkSession
    label_type = df.schema[label].dataType.simpleString()
    id_type = df.schema[row_id].dataType.simpleString()
    keyed = df.select(
        F.col(label).alias("label"), F.col(row_id).alias("id"), order_key(row_id, seed).alias("key")
    ).withColumn("prefix", F.substring("key", 1, PREFIX_DIGITS))
    in_class = Window.partitionBy("label").orderBy("prefix")
    reached = (
        keyed.groupBy("label", "prefix")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(in_class))
    )
    wanted = spark.createDataFrame(
        [(c, i, r) for c, rs in cuts.items() for i, r in enumerate(rs)],
        f"label {label_type}, cut int, rank bigint",
    )
    located = (
        reached.join(F.broadcast(wanted), "label")
        .where((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto")))
        .select("label", "prefix", "cut", (F.col("rank") - F.col("upto") + F.col("n")).alias("r"))
    )
    near = Window.partitionBy("label", "prefix", "cut").orderBy("key", "id")
    found = (
        keyed.join(F.broadcast(located), ["label", "prefix"])
        .withColumn("rn", F.row_number().over(near))
        .where(F.col("rn") == F.col("r"))
        .select("label", "cut", "key", "id")
        .collect()
    )
    at = {(r["label"], r["cut"]): (r["key"], r["id"]) for r in found}
    marks = [
        (c, [at.get((c, i), ("", None)) for i in range(len(rs))]) for c, rs in cuts.items()
    ]
    return spark.createDataFrame(
        marks, f"_class {label_type}, marks array<struct<key:string,id:{id_type}>>"
    )


def _with_rank_group(
    df: DataFrame, label: str, row_id: str, seed: int, marks: DataFrame
) -> DataFrame:
    """Add ``_group``: how many marks of its class lie before the row."""
    own = F.struct(order_key(row_id, seed).alias("key"), F.col(row_id).alias("id"))
    joined = df.withColumn("_own", own).join(
        F.broadcast(marks), F.col(label) == F.col("_class")
    )
    passed = F.size(F.filter("marks", lambda m: m < F.col("_own")))
    return joined.withColumn("_group", passed).drop("_own", "_class", "marks")


def stratified_split(
    df: DataFrame,
    label: str,
    row_id: str,
    counts: dict,
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add ``is_test``; ``counts`` holds the rows per class."""
    cuts = {c: [k] for c, k in test_counts(counts, test_size).items()}
    marks = rank_marks(df, label, row_id, seed, cuts)
    grouped = _with_rank_group(df, label, row_id, seed, marks)
    return grouped.withColumn("is_test", F.col("_group") == 0).drop("_group")


def stratified_folds(
    df: DataFrame, label: str, row_id: str, counts: dict, folds: int = 3, seed: int = 42
) -> DataFrame:
    """Add ``fold`` in 0 .. folds-1, contiguous in the hash order of each class."""
    cuts = {}
    for c, sizes in fold_counts(counts, folds).items():
        ends = [sum(sizes[: i + 1]) for i in range(folds - 1)]
        cuts[c] = ends
    marks = rank_marks(df, label, row_id, seed, cuts)
    return _with_rank_group(df, label, row_id, seed, marks).withColumnRenamed("_group", "fold")
