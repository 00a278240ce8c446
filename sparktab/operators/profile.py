"""Profiling: shape, missing values, duplicates, summaries, histograms, correlation.

Every operator takes a DataFrame and returns a small DataFrame. Statistics of all
columns share one scan; only exact value counts shuffle, after a map-side combine.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions.quantiles import exact_quantiles
from sparktab.functions.scalars import missing, nan_to_null
from sparktab.session import combine_single_rows

CORRELATIONS_PER_JOB = 200


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def column_roles(df: DataFrame) -> DataFrame:
    """(column, role, non_null): numeric by type, everything else categorical."""
    numeric = set(numeric_columns(df))
    return _per_column(
        df,
        lambda c, d: {
            "role": F.lit("numeric" if c in numeric else "categorical"),
            "non_null": F.count_if(~missing(c, d)),
        },
    )


def _per_column(df: DataFrame, stats, columns: list[str] | None = None) -> DataFrame:
    """One aggregation over all columns, returned as one row per column."""
    types = dict(df.dtypes)
    rows = [
        F.struct(
            F.lit(c).alias("column"), *[e.alias(n) for n, e in stats(c, types[c]).items()]
        )
        for c in columns or df.columns
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "cols", F.lit(len(df.columns)).cast("bigint")
    )


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing) with null and NaN both counted."""
    return _per_column(df, lambda c, d: {"missing": F.count_if(missing(c, d))})


def dtypes_table(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null)."""
    return _per_column(
        df, lambda c, d: {"dtype": F.lit(d), "non_null": F.count_if(~missing(c, d))}
    )


def head(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """First rows in a stated total order."""
    return df.orderBy(*order_by).limit(n)


def row_digest(df: DataFrame) -> Column:
    """32-byte digest of a whole row; equal rows, NaN and null included, share it."""
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            text = (c + F.lit(0.0)).cast("string")
        elif isinstance(f.dataType, T.BinaryType):
            text = F.hex(c)
        elif isinstance(f.dataType, (T.ArrayType, T.StructType)):
            text = F.to_json(F.struct(c))
        else:
            text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows after the first of each group of equal rows.

    Rows with text are grouped by digest, so the shuffle carries 32 bytes a row
    instead of the texts.
    """
    fixed = all(
        isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType)) for f in df.schema
    )
    if fixed and len(df.columns) <= 4:
        groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    else:
        groups = df.select(row_digest(df).alias("digest")).groupBy("digest").agg(
            F.count(F.lit(1)).alias("n")
        )
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """(target, count), most frequent class first; empty without the column."""
    if target not in df.columns:
        return df.sparkSession.createDataFrame([], "target string, count bigint")
    value = nan_to_null(target, dict(df.dtypes)[target])
    return (
        df.select(value.alias("target"))
        .where(F.col("target").isNotNull())
        .groupBy("target")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "target")
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per numeric column."""
    columns = numeric_columns(df) if columns is None else columns
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])

    def stats(c: str, dtype: str) -> dict[str, Column]:
        x = nan_to_null(c, dtype).cast("double")
        q = [F.lit(v).cast("double") for v in quartiles[c]]
        return {
            "count": F.count(x),
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "min": F.min(x),
            "q25": q[0],
            "q50": q[1],
            "q75": q[2],
            "max": F.max(x),
        }

    return _per_column(df, stats, columns)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for every listed column in one shuffle; null is a value."""
    texts = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long = texts.unpivot([], columns, "column", "value") if len(columns) > 1 else texts.select(
        F.lit(columns[0]).alias("column"), F.col(f"`{columns[0]}`").alias("value")
    )
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, unique, top and freq per non-numeric column; the smallest value wins ties."""
    columns = categorical_columns(df) if columns is None else columns
    present = F.col("value").isNotNull()
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.sum(F.when(present, F.col("n")).otherwise(0)).alias("count"),
            F.count("value").alias("unique"),
            F.min(F.when(present, F.struct((-F.col("n")).alias("neg"), "value"))).alias("best"),
        )
        .select(
            "column",
            "count",
            "unique",
            F.col("best.value").alias("top"),
            (-F.col("best.neg")).alias("freq"),
        )
    )


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value of each column, the smallest on ties."""
    if not columns:
        return {}
    rows = describe_categorical(df, columns).select("column", "top").collect()
    found = {r["column"]: r["top"] for r in rows}
    return {c: found.get(c) for c in columns}


def category_lists(
    df: DataFrame, columns: list[str]
) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Ascending distinct values and the mode of each column that has any.

    For columns whose number of values is known to be small.
    """
    if not columns:
        return {}, {}
    rows = (
        value_counts(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(
            F.array_sort(F.collect_list("value")).alias("labels"),
            F.min(F.struct((-F.col("n")).alias("neg"), "value"))["value"].alias("top"),
        )
        .collect()
    )
    return {r["column"]: r["labels"] for r in rows}, {r["column"]: r["top"] for r in rows}


def low_cardinality_columns(df: DataFrame, limit: int = 10) -> list[str]:
    """Non-numeric columns with at most ``limit`` distinct values.

    A sketch over one scan rules out the columns that are far above the limit; the
    few left are counted exactly, which shuffles only their small value sets.
    """
    columns = categorical_columns(df)
    if not columns:
        return []
    sketch = df.agg(
        *[F.approx_count_distinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)]
    ).first()
    near = [c for i, c in enumerate(columns) if sketch[str(i)] <= 4 * limit + 10]
    if not near:
        return []
    exact = value_counts(df, near).groupBy("column").agg(F.count("value").alias("d")).collect()
    distinct = {r["column"]: r["d"] for r in exact}
    return [c for c in near if distinct.get(c, 0) <= limit]


def category_counts(df: DataFrame, limit: int = 10) -> DataFrame:
    """(column, value, n) for every low-cardinality non-numeric column, null left out."""
    columns = low_cardinality_columns(df, limit)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    return value_counts(df, columns).where(F.col("value").isNotNull())


def low_cardinality_table(df: DataFrame, limit: int = 10) -> DataFrame:
    """(column, n_distinct) of the low-cardinality columns."""
    return category_counts(df, limit).groupBy("column").agg(F.count("value").alias("n_distinct"))


def value_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each column in one scan; all-null columns left out."""
    types = dict(df.dtypes)
    exprs = []
    for i, c in enumerate(columns):
        x = nan_to_null(c, types[c]).cast("double")
        exprs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*exprs).first()
    bounds = {}
    for i, c in enumerate(columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is not None:
            bounds[c] = (lo, hi) if lo < hi else (lo - 0.5, hi + 0.5)
    return bounds


def equal_width_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin number over [lo, hi]: half-open bins on exact edges, the last one closed."""
    step = (hi - lo) / bins
    raw = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))
    return (
        F.when(x.isNull(), None)
        .when(x < lo + raw * step, raw - 1)
        .when((raw < bins - 1) & (x >= lo + (raw + 1) * step), raw + 1)
        .otherwise(raw)
    )


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 15) -> DataFrame:
    """(column, bin, lower, upper, n) with every bin present."""
    columns = numeric_columns(df) if columns is None else columns
    bounds = value_bounds(df, columns)
    types = dict(df.dtypes)
    if not bounds:
        return df.sparkSession.createDataFrame(
            [], "column string, bin bigint, lower double, upper double, n bigint"
        )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(lo).alias("lo"),
            F.lit(hi).alias("hi"),
            equal_width_bin(nan_to_null(c, types[c]).cast("double"), lo, hi, bins).alias("bin"),
        )
        for c, (lo, hi) in bounds.items()
    ]
    counted = (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .where(F.col("bin").isNotNull())
        .groupBy("column", "lo", "hi", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    filled = (
        counted.groupBy("column", "lo", "hi")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
        .select(
            "column", "lo", "hi", "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
        )
    )
    step = (F.col("hi") - F.col("lo")) / bins
    return filled.select(
        "column",
        F.col("bin").cast("bigint").alias("bin"),
        (F.col("lo") + F.col("bin") * step).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("upper"),
        F.coalesce(F.try_element_at("m", F.col("bin").cast("bigint")), F.lit(0)).alias("n"),
    )


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x, y, corr) for every ordered pair, each pair over its own complete rows."""
    columns = numeric_columns(df) if columns is None else columns
    types = dict(df.dtypes)
    data = df.select([nan_to_null(c, types[c]).cast("double").alias(c) for c in columns])
    pairs = list(combinations(columns, 2)) + [(c, c) for c in columns]
    frames = []
    for start in range(0, len(pairs), CORRELATIONS_PER_JOB):
        rows = [
            F.struct(
                F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(f"`{a}`", f"`{b}`").alias("corr")
            )
            for a, b in pairs[start : start + CORRELATIONS_PER_JOB]
        ]
        frames.append(data.agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    upper = frames[0]
    for frame in frames[1:]:
        upper = upper.unionByName(frame)
    both = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y", "corr"))).otherwise(
        F.array(F.struct("x", "y", "corr"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "corr"))
    )
    return upper.select(F.inline(both))


def pair_grid(
    df: DataFrame, columns: list[str] | None = None, bins: int = 15, first: int = 6
) -> DataFrame:
    """(x, y, x_bin, y_bin, n): density of every column pair, histogram on the diagonal.

    Covers the first ``first`` numeric columns over rows complete in all of them.
    The panel (y, x) mirrors (x, y) and is not repeated.
    """
    columns = (numeric_columns(df) if columns is None else columns)[:first]
    types = dict(df.dtypes)
    data = df.select([nan_to_null(c, types[c]).cast("double").alias(c) for c in columns]).na.drop()
    bounds = value_bounds(data, columns)
    if not bounds:
        return df.sparkSession.createDataFrame(
            [], "x string, y string, x_bin bigint, y_bin bigint, n bigint"
        )
    binned = data.select(
        [equal_width_bin(F.col(f"`{c}`"), *bounds[c], bins).alias(c) for c in columns]
    )
    panels = list(combinations(columns, 2)) + [(c, c) for c in columns]
    entries = [
        F.struct(
            F.lit(a).alias("x"),
            F.lit(b).alias("y"),
            F.col(f"`{a}`").alias("x_bin"),
            F.col(f"`{b}`").alias("y_bin"),
        )
        for a, b in panels
    ]
    return (
        binned.select(F.inline(F.array(*entries)))
        .groupBy("x", "y", "x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quality_report(df: DataFrame, target: str = "target") -> DataFrame:
    """One nested row: shape, columns, missing values, duplicates, classes, summary."""
    types = dict(df.dtypes)
    numeric = numeric_columns(df)
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    gaps = [x for c in df.columns for x in (F.lit(c), F.count_if(missing(c, types[c])))]
    summaries = []
    for c in numeric:
        x = nan_to_null(c, types[c]).cast("double")
        q = [F.lit(v).cast("double") for v in quartiles[c]]
        summaries += [
            F.lit(c),
            F.struct(
                F.count(x).cast("double").alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                q[0].alias("q25"),
                q[1].alias("q50"),
                q[2].alias("q75"),
                F.max(x).alias("max"),
            ),
        ]
    base = df.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("cols")
        ).alias("shape"),
        F.map_from_arrays(F.array(*gaps[0::2]), F.array(*gaps[1::2])).alias("missing_values"),
        *(
            [
                F.map_from_arrays(F.array(*summaries[0::2]), F.array(*summaries[1::2])).alias(
                    "numeric_summary"
                )
            ]
            if numeric
            else []
        ),
    ).withColumn("columns", F.array(*[F.lit(c) for c in df.columns]))
    classes = target_distribution(df, target).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("target").cast("string"), "count"))
        ).alias("target_distribution")
    )
    return combine_single_rows(base, duplicate_rows(df), classes)


def report_lines(df: DataFrame, target: str = "target") -> DataFrame:
    """The quality report as ordered Markdown lines (line_no, text)."""
    report = quality_report(df, target)
    names = F.col("columns")
    missing_part = F.transform(
        names, lambda c: F.format_string("- %s: %d", c, F.element_at("missing_values", c))
    )
    by_count = F.transform(
        F.array_sort(
            F.transform(
                F.map_entries("target_distribution"),
                lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key")),
            )
        ),
        lambda e: F.format_string("- Class %s: %d", e["key"], -e["neg"]),
    )
    class_part = F.when(
        F.size("target_distribution") > 0,
        F.concat(F.array(F.lit(""), F.lit("## Target distribution")), by_count),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(
            F.lit("# Data Quality Report"),
            F.lit(""),
            F.format_string("- Shape: %d rows x %d columns", F.col("shape.rows"), F.col("shape.cols")),
            F.format_string("- Duplicate rows: %d", F.col("duplicate_rows")),
            F.lit(""),
            F.lit("## Missing values"),
        ),
        missing_part,
        class_part,
    )
    return report.select(F.posexplode(lines).alias("line_no", "text")).select(
        F.col("line_no").cast("bigint"), "text"
    )


def explore(df: DataFrame, order_by: list[str], target: str = "target") -> dict[str, DataFrame]:
    """The exploration report as named frames."""
    numeric, other = numeric_columns(df), categorical_columns(df)
    frames = {
        "shape": shape(df),
        "head": head(df, order_by),
        "dtypes": dtypes_table(df),
        "missing": missing_values(df),
        "target_distribution": target_distribution(df, target),
    }
    if numeric:
        frames["describe_numeric"] = describe_numeric(df, numeric)
        frames["histogram"] = histogram(df, numeric)
        frames["correlation"] = correlation_matrix(df, numeric)
        frames["pair_grid"] = pair_grid(df, numeric)
    if other:
        frames["describe_categorical"] = describe_categorical(df, other)
        frames["category_counts"] = category_counts(df)
    return frames
