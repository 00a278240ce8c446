"""Preview, cleaning and preparation of a table for modelling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_ID = "_row_id"


def check_columns(df: DataFrame, columns: list[str], message: str = "Unknown columns") -> None:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"{message}: {unknown}")


def class_filter(df: DataFrame, target: str, classes: list) -> DataFrame:
    """Rows of the listed classes; an empty list keeps none."""
    return df.where(F.col(target).isin(*classes)) if classes else df.where(F.lit(False))


def feature_columns(df: DataFrame, target: str, row_id: str = ROW_ID) -> list[str]:
    return [c for c in df.columns if c not in (target, row_id)]


@dataclass
class Preview:
    """Columns, row count of the whole filtered table, and its first rows."""

    columns: list[str]
    filtered: DataFrame
    rows: DataFrame

    def shape(self) -> DataFrame:
        return self.filtered.agg(F.count(F.lit(1)).alias("rows")).withColumn(
            "cols", F.lit(len(self.columns)).cast("bigint")
        )


def preview(
    df: DataFrame,
    limit: int = 10,
    selected_columns: list[str] | None = None,
    selected_classes: list | None = None,
    target_column: str = "target",
    row_id: str = ROW_ID,
) -> Preview:
    """Class filter, projection and the first ``limit`` rows in ``row_id`` order."""
    if selected_classes and target_column in df.columns:
        df = class_filter(df, target_column, selected_classes)
    columns = [c for c in df.columns if c != ROW_ID]
    if selected_columns:
        check_columns(df, selected_columns)
        columns = list(selected_columns)
    rows = df.orderBy(row_id).limit(limit).select(*columns)
    return Preview(columns, df.select(*columns), rows)


def drop_duplicates(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """One row per distinct content, the first by ``row_id`` where the table has one."""
    if row_id not in df.columns:
        return df.dropDuplicates()
    content = [c for c in df.columns if c != row_id]
    return df.groupBy(*content).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def drop_missing(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Rows without null or NaN in any projected column."""
    return df.na.drop("any", subset=[c for c in df.columns if c != row_id])


def clean_summary(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """(rows_before, rows_after, rows_removed) of ``drop_missing`` in one pass."""
    types = dict(df.dtypes)
    complete = F.lit(True)
    for c in df.columns:
        if c != row_id:
            present = F.col(f"`{c}`").isNotNull()
            if types[c] in ("double", "float"):
                present = present & ~F.isnan(F.col(f"`{c}`"))
            complete = complete & present
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(complete).alias("rows_after")
    ).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def prepare(
    df: DataFrame,
    target: str,
    selected_columns: list[str] | None = None,
    selected_classes: list | None = None,
    clean_missing: str = "none",
    dedupe: bool = False,
    row_id: str = ROW_ID,
) -> DataFrame:
    """Project, filter classes, drop duplicates, drop missing: lazily, in this order.

    Duplicates are judged on the projected columns; ``row_id`` rides along.
    """
    if target not in df.columns:
        raise ValueError(f"Target column not found: {target}")
    if selected_columns:
        wanted = list(dict.fromkeys([*selected_columns, target]))
        check_columns(df, wanted, "Unknown selected columns")
        keep_id = [row_id] if row_id in df.columns and row_id not in wanted else []
        df = df.select(*keep_id, *wanted)
    if selected_classes is not None:
        df = class_filter(df, target, selected_classes)
    if dedupe:
        df = drop_duplicates(df, row_id)
    if clean_missing == "dropna":
        df = drop_missing(df, row_id)
    elif clean_missing != "none":
        raise ValueError(f"Unknown cleaning strategy: {clean_missing}")
    return df


def validate(df: DataFrame, target: str, row_id: str = ROW_ID) -> dict:
    """Check a prepared table and return its rows per class, smallest class value first."""
    groups = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    counts = {r[target]: r["n"] for r in groups.toLocalIterator()}
    if not counts:
        raise ValueError("No rows left after applying filters/cleaning.")
    if not feature_columns(df, target, row_id):
        raise ValueError("No feature columns available after selection.")
    if any(v is None or v != v for v in counts):
        raise ValueError(f"Target column {target} has missing labels; drop or fill them first.")
    if len(counts) < 2:
        raise ValueError("Target must contain at least 2 classes for classification.")
    return dict(sorted(counts.items()))
