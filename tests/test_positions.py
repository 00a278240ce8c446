import pytest
from pyspark.sql import functions as F

from sparktab.operators import positions


def test_positions_follow_the_order_of_the_table(spark):
    df = spark.range(0, 1000, 1, 7).where("id % 3 <> 0 and id not between 150 and 420")
    rows = positions.numbered(df).orderBy("id").collect()
    assert [r._position for r in rows] == list(range(len(rows)))
    assert positions.numbered(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="exists"):
        positions.numbered(df, "id")


def test_equal_rows_keep_their_partner(spark):
    df = spark.range(0, 600, 1, 5).select(F.lit("same").alias("x"), F.col("id").alias("y"))
    out = positions.attach(df.select("x"), df.select("y").repartition(1).sortWithinPartitions("y"))
    assert sorted(r.y for r in out.collect()) == list(range(600)) and out.columns == ["x", "y"]
    twice = positions.attach(df.select(F.col("y").alias("a")), df.select("y"))
    assert twice.where("a = y").count() == 600


def test_tables_that_do_not_fit_are_errors(spark):
    df = spark.range(10)
    with pytest.raises(ValueError, match="different length"):
        positions.attach(df, spark.range(9).withColumnRenamed("id", "y"))
    with pytest.raises(ValueError, match="both tables"):
        positions.attach(df, df)
