"""CSV in and out with typed columns and the usual missing-value tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts read as missing.
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"
INTEGER = r"^\s*[+-]?[0-9]+\s*$"


def _present(c: str) -> Column:
    return F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`"))


def _as_double(c: Column) -> Column:
    return F.when(c.rlike(NUMBER) | c.rlike(INFINITY), F.trim(c).try_cast("double"))


def _as_long(c: Column) -> Column:
    return F.when(c.rlike(INTEGER), F.trim(c).try_cast("bigint"))


def _is_boolean(c: Column) -> Column:
    return c.isin("True", "TRUE", "true", "False", "FALSE", "false")


def read_text_columns(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as text. ``multiline`` allows line breaks inside quotes but stops
    Spark from splitting large files, so it is off unless asked for."""
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("inferSchema", False)
        .csv(path)
    )


def infer_types(raw: DataFrame) -> T.StructType:
    """Long, double, boolean or string per column, from one pass over the texts."""
    checks = []
    for i, c in enumerate(raw.columns):
        v = _present(c)
        checks += [
            F.count(v).alias(f"n{i}"),
            F.count(_as_long(v)).alias(f"l{i}"),
            F.count(_as_double(v)).alias(f"d{i}"),
            F.count_if(_is_boolean(v)).alias(f"b{i}"),
        ]
    row = raw.agg(*checks).first()
    fields = []
    for i, c in enumerate(raw.columns):
        n = row[f"n{i}"]
        if n == 0:
            kind = T.DoubleType()
        elif row[f"l{i}"] == n:
            kind = T.LongType()
        elif row[f"d{i}"] == n:
            kind = T.DoubleType()
        elif row[f"b{i}"] == n:
            kind = T.BooleanType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(c, kind))
    return T.StructType(fields)


def apply_types(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """One projection from texts to typed, null-normalised columns."""
    out = []
    for f in schema:
        v = _present(f.name)
        if isinstance(f.dataType, T.LongType):
            v = _as_long(v)
        elif isinstance(f.dataType, T.DoubleType):
            v = _as_double(v)
        elif isinstance(f.dataType, T.BooleanType):
            v = F.when(_is_boolean(v), F.lower(v) == "true")
        out.append(v.cast(f.dataType).alias(f.name))
    return raw.select(*out)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = False
) -> DataFrame:
    """Typed table from CSV with a header; types are inferred when no schema is given."""
    raw = read_text_columns(spark, path, multiline)
    return apply_types(raw, schema or infer_types(raw))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; missing cells are empty."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
