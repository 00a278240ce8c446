import os

from pyspark.sql import functions as F

from sparktab.session import cut_lineage, release


def _file(df):
    return df._jdf.logicalPlan().rdd().getCheckpointFile().get().removeprefix("file:")


def test_release_deletes_only_what_it_is_given(spark):
    first = cut_lineage(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    second = cut_lineage(first.where("k > 2"))
    gone, kept = _file(first), _file(second)
    assert os.path.isdir(gone) and os.path.isdir(kept)
    release(first)
    assert not os.path.exists(gone) and second.count() == 4
    release(second, spark.range(3).checkpoint())
    release(first)  # twice is no error
    assert not os.path.exists(kept)
