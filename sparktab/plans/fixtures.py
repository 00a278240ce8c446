"""Views derived from the given tables that give the operators something to chew on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.operators.runs import parse_metadata

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
NUMERIC = FEATURES[:4]
CATEGORICAL = FEATURES[4:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    sizes = [F.col("l_quantity").cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint")]
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *keys, *sizes).alias("row_id"),
        *FEATURES,
        (net > 50000).cast("int").alias("target"),
        "l_orderkey",
        "l_linenumber",
    )


def clf_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a learnable binary target and a row id of their keys, quantity and price, which
    together tell all rows of the given tables apart (the keys alone do not)."""
    return _keyed_lineitem(spark, sf_dir).select("row_id", *FEATURES, "target")


def clf_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clf_base`` with missing quantities and return flags."""
    key = F.col("l_orderkey") + F.col("l_linenumber")
    return _keyed_lineitem(spark, sf_dir).select(
        "row_id",
        F.when(key % 11 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        "l_discount",
        "l_tax",
        F.when(key % 13 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
        "target",
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clf_base`` with a fixed, imperfect probability full of ties."""
    raw = F.floor(60 * F.col("l_extendedprice") / 100000 + 40 * F.col("l_quantity") / 50) / 100
    p = F.least(F.greatest(raw, F.lit(0.01)), F.lit(0.99))
    base = clf_base(spark, sf_dir).withColumn("p", p)
    return base.select(
        "row_id",
        *FEATURES,
        F.col("target").alias("label"),
        "p",
        (F.col("p") > 0.5).cast("int").alias("prediction"),
        F.array(1 - F.col("p"), F.col("p")).alias("probability"),
    )


def scored_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with ten class shares taken from the first ten coordinates."""
    parts = [F.abs(F.col("embedding")[i].cast("double")) for i in range(10)]
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    shares = F.array(*[x / total for x in parts])
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "label", shares.alias("probability"))
        .withColumn(
            "prediction",
            (F.array_position("probability", F.array_max("probability")) - 1).cast("int"),
        )
    )


def clf_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their ten-class label."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", vec.alias("vec"), "label")


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders recast as raw run records: tags, parameters and JSON texts.

    Partly filled orders carry unreadable JSON, urgent open ones no model name, and
    only even customers name their ranking metric.
    """
    share = F.col("o_totalprice") / 500000
    readable = F.col("o_orderstatus") != "P"
    nothing = F.lit(None).cast("string")
    pairs = F.array(
        F.struct(
            F.lit("model_name"),
            F.when(
                (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), ""
            ).otherwise(F.col("o_orderpriority")),
        ),
        F.struct(F.lit("session_id"), F.concat(F.lit("s"), F.col("o_custkey").cast("string"))),
        F.struct(
            F.lit("optimize_metric"), F.when(F.col("o_custkey") % 2 == 0, "accuracy").otherwise(nothing)
        ),
    )
    scores = F.struct(
        share.alias("accuracy"),
        (share * 0.9).alias("f1"),
        F.when(F.col("o_orderstatus") == "F", share * 0.95).alias("roc_auc"),
    )
    depth = F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("start_time"),
        F.map_filter(F.map_from_entries(pairs), lambda k, v: v.isNotNull()).alias("tags"),
        F.create_map(F.lit("hp_max_depth"), depth, F.lit("note"), F.lit("x")).alias("params"),
        F.create_map(F.lit("accuracy"), share).alias("metrics_base"),
        F.when(readable, F.to_json(scores)).otherwise("{broken").alias("metrics_json"),
        F.when(readable, F.to_json(F.create_map(F.lit("max_depth"), depth)))
        .otherwise("{broken")
        .alias("hyperparameters_json"),
    )


def runs_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_metadata(raw_runs(spark, sf_dir))


def run_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap orders count as deleted runs."""
    return (
        table(spark, sf_dir, "orders")
        .where("o_totalprice < 25000")
        .select(
            F.col("o_orderkey").cast("string").alias("run_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
        )
    )


def run_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dear orders count as activations."""
    return (
        table(spark, sf_dir, "orders")
        .where("o_totalprice > 400000")
        .select(
            F.lit("model").alias("kind"),
            F.col("o_orderkey").cast("string").alias("version"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
        )
    )
