import pytest
from pyspark.sql import functions as F

from sparktab.operators import split


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(0, 1000, 1, 5).select(
        F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("y")
    )


COUNTS = {0: 857, 1: 143}


def sides(df):
    return {r["row_id"]: r["is_test"] for r in df.collect()}


def test_split_is_exact_and_independent_of_partitioning(spark, rows):
    one = sides(split.stratified_split(rows, "y", "row_id", COUNTS, 0.2, 1))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = sides(split.stratified_split(rows.repartition(4), "y", "row_id", COUNTS, 0.2, 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one == two and len(one) == 1000
    assert sum(one.values()) == 200
    assert sum(t for i, t in one.items() if i % 7 == 0) == split.test_counts(COUNTS, 0.2)[1]
    assert one != sides(split.stratified_split(rows, "y", "row_id", COUNTS, 0.2, 2))


def test_counts_follow_the_largest_remainder():
    assert split.test_counts({0: 499, 1: 526}, 0.2) == {0: 100, 1: 105}
    with pytest.raises(ValueError):
        split.test_counts({0: 5, 1: 1}, 0.2)
    with pytest.raises(ValueError):
        split.test_counts({"a": 2, "b": 2, "c": 2}, 0.2)


def test_folds_are_balanced_and_complete(rows):
    out = split.stratified_folds(rows, "y", "row_id", COUNTS, 4, 3)
    sizes = {(r["y"], r["fold"]): r["count"] for r in out.groupBy("y", "fold").count().collect()}
    assert sum(sizes.values()) == 1000 and len(sizes) == 8
    for y in (0, 1):
        own = [n for (c, _), n in sizes.items() if c == y]
        assert max(own) - min(own) <= 1
    by_fold = [sizes[(0, f)] + sizes[(1, f)] for f in range(4)]
    assert max(by_fold) - min(by_fold) <= 1
    with pytest.raises(ValueError):
        split.fold_counts({0: 2, 1: 2}, 3)


def test_the_table_itself_is_not_shuffled(rows):
    plan = split.stratified_split(rows, "y", "row_id", COUNTS)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "hashpartitioning" not in text and "SinglePartition" not in text
