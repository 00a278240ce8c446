import pytest
from pyspark.sql import functions as F

from sparktab import session
from sparktab.plans.workflows import HeldOut


def table(spark, rows=3000):
    x = F.sin(F.col("id") * 12.9898) * 43758.5453
    return spark.range(0, rows, 1, 4).select(
        F.concat(F.lit("r"), "id").alias("row_id"),
        (x - F.floor(x)).alias("x"),
        F.when(F.col("id") % 7 != 0, F.col("id") % 11).cast("double").alias("y"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("c"),
        ((x - F.floor(x)) * 10 + F.col("id") % 11 > 10).cast("int").alias("target"),
    )


def test_partitions_of_a_stored_table_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_FILE", 100)
    stored, path = session.store(spark.range(0, 10_000, 1, 2).toDF("row_id"), "bounded")
    assert stored.count() == 10_000
    most = max(r["count"] for r in stored.groupBy(F.spark_partition_id()).count().collect())
    assert most <= 3200
    session.remove(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_split_and_encoding_are_done_once(spark):
    held = HeldOut(table(spark), "target", 0.2, 42, "row_id")
    plan = held.train._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and "UDF" not in plan
    assert held.train.count() == 2400 and held.test.count() == 600
    assert held.train.schema["features"].metadata["ml_attr"]["num_attrs"] == held.train.first()["features"].size
    lazily = held.encoder.transform(held.train_rows).select("row_id", "target", "label", "features")
    assert held.train.exceptAll(lazily).count() == 0
    held.close()
