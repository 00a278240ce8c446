import pytest
from pyspark.sql import functions as F

from sparktab.operators import prep, profile


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (0, 1.0, "x", 0),
        (1, 1.0, "x", 0),
        (2, float("nan"), "y", 1),
        (3, None, "y", 1),
        (4, 2.0, None, 1),
        (5, 3.0, "z", 2),
    ]
    return spark.createDataFrame(rows, "_row_id bigint, a double, b string, target int")


def test_order_of_preparation(df):
    out = prep.prepare(df, "target", ["b"], [0, 1], "dropna", True)
    assert [tuple(r) for r in out.orderBy("_row_id").collect()] == [(0, "x", 0), (2, "y", 1)]


def test_nan_rows_equal_and_incomplete(df):
    assert prep.prepare(df, "target", ["a"], None, "none", True).count() == 5
    assert prep.prepare(df, "target", ["a"], None, "dropna").count() == 4
    row = prep.clean_summary(df).first()
    assert (row["rows_before"], row["rows_removed"]) == (6, 3)


def test_empty_class_list(df):
    assert prep.preview(df, 10, None, []).filtered.count() == 6
    with pytest.raises(ValueError, match="No rows"):
        prep.validate(prep.prepare(df, "target", None, []), "target")


def test_errors(df):
    with pytest.raises(ValueError, match="Unknown columns"):
        prep.preview(df, 1, ["nope"])
    with pytest.raises(ValueError, match="Unknown selected columns"):
        prep.prepare(df, "target", ["nope"])
    with pytest.raises(ValueError, match="not found"):
        prep.prepare(df, "nope")
    with pytest.raises(ValueError, match="at least 2"):
        prep.validate(prep.prepare(df, "target", None, [0]), "target")
    with pytest.raises(ValueError, match="feature columns"):
        prep.validate(df.select("_row_id", "target"), "target")
    with pytest.raises(ValueError, match="missing labels"):
        prep.validate(df.withColumnRenamed("b", "y").drop("target"), "y")


def test_preview_keeps_request_order_and_limits_late(df):
    view = prep.preview(df, 2, ["b", "a"], [1, 2])
    assert view.columns == ["b", "a"]
    assert view.filtered.count() == 4 and view.rows.count() == 2


def test_profile_edges(spark, df):
    missing = {r["column"]: r["missing"] for r in profile.missing_values(df).collect()}
    assert missing["a"] == 2 and missing["b"] == 1
    flat = spark.createDataFrame([(3.0, True), (3.0, False)], "c double, f boolean")
    bins = {r["bin"]: r["n"] for r in profile.histogram(flat).collect()}
    assert sum(bins.values()) == 2 and bins[7] == 2 and len(bins) == 15
    assert profile.categorical_columns(flat) == ["f"]
    counts = {(r["column"], r["value"]): r["n"] for r in profile.category_counts(flat).collect()}
    assert counts == {("f", "true"): 1, ("f", "false"): 1}
    twins = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("ab", "c")], "x string, y string")
    assert profile.duplicate_rows(twins).first()[0] == 1
    top = profile.describe_categorical(spark.createDataFrame([("q",), ("p",), (None,)], "s string")).first()
    assert (top["count"], top["unique"], top["top"], top["freq"]) == (2, 2, "p", 1)


def test_explore_has_all_parts(df):
    parts = profile.explore(df, ["_row_id"])
    assert {"shape", "histogram", "correlation", "pair_grid", "describe_categorical"} <= set(parts)
    for frame in parts.values():
        frame.collect()


def test_a_target_may_have_many_classes(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.col("id").alias("x"), (F.col("id") % 1500).alias("y"))
    counts = prep.validate(df, "y")
    assert len(counts) == 1500 and set(counts.values()) == {2}
