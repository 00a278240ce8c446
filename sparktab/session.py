"""Session helpers: shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session with
    nothing configured gets a temporary folder; a cluster without one is an error,
    because a machine-local path is lost with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparktab-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/sparktab/{name}-{uuid.uuid4().hex}"


#: Rows of one scratch file at most. A scan counts every file as 4 MB more than it has, so a
#: partition of 128 MB holds 32 files at most, however well the rows are compressed.
ROWS_PER_FILE = 65_536


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written once below the shared folder and read back, and where they are.

    For tables that are read many times: no pass repeats the work before them, no memory
    is held between passes, and the rows of a partition are bounded whatever the table's size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no later job reads."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Have the driver collect what nothing refers to, upon which Spark deletes the shuffle files of finished jobs."""
    spark._jvm.System.gc()


def release(*frames: DataFrame) -> None:
    """Delete the checkpoints of frames that no later job reads, and let Spark drop the shuffles of finished jobs.

    Every frame derived from them must have been checkpointed or written itself. Shuffle files
    go when the driver collects their last reference; iterative jobs should not wait for that.
    """
    for df in frames:
        plan = df._jdf.logicalPlan()
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    for spark in {df.sparkSession for df in frames}:
        drop_finished_shuffles(spark)


def combine_single_rows(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with different columns into one row, without a join."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.first(c, ignorenulls=True).alias(c) for c in merged.columns])
