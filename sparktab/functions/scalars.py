"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported algorithms and the aliases that name them.
ALGORITHMS = [
    "svm",
    "random_forest",
    "adaboost",
    "xgboost",
    "knn",
    "logistic_regression",
    "neural_network",
]
ALGORITHM_ALIASES = {
    "rf": "random_forest",
    "randomforest": "random_forest",
    "random_forest": "random_forest",
    "ada": "adaboost",
    "ada_boost": "adaboost",
    "adaboost": "adaboost",
    "xgb": "xgboost",
    "xgboost": "xgboost",
    "logreg": "logistic_regression",
    "logistic": "logistic_regression",
    "logistic_regression": "logistic_regression",
    "svm": "svm",
    "knn": "knn",
    "nn": "neural_network",
    "mlp": "neural_network",
    "neural_network": "neural_network",
}


def normalize_algorithm(name: Column) -> Column:
    """Canonical algorithm of each row; null where the name is not supported."""
    pairs = [F.lit(x) for kv in ALGORITHM_ALIASES.items() for x in kv]
    key = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))
    return F.try_element_at(F.create_map(*pairs), key)


def algorithm_name(name: str) -> str:
    """Canonical algorithm of one request; an unsupported name raises."""
    known = ALGORITHM_ALIASES.get("_".join(name.strip().lower().split(" ")))
    if known is None:
        raise ValueError(f"Unsupported model: {name}")
    return known


def timestamp_id(ts: Column) -> Column:
    """UTC time as sortable id text, to the microsecond (session time zone UTC)."""
    return F.date_format(ts, "yyyyMMdd_HHmmss_SSSSSS")


def percent(value: Column) -> Column:
    """Share as a percentage with two decimals; a missing share counts as 0."""
    return F.round(F.coalesce(value, F.lit(0.0)) * 100, 2)


def strip_parameter_prefix(params: Column) -> Column:
    """Parameter map with ``hp_`` and ``estimator__`` removed from its keys."""
    return F.transform_keys(params, lambda k, v: F.regexp_replace(k, "^(hp_|estimator__)", ""))


def strip_prefix(params: dict) -> dict:
    """Same for a request's dictionary."""
    return {k.removeprefix("estimator__").removeprefix("hp_"): v for k, v in params.items()}


def base_column(encoded: Column) -> Column:
    """Source column of an encoded slot named ``num__<column>`` or ``cat__<column>``."""
    return F.regexp_replace(encoded, "^(num|cat)__", "")


def number_or_null(text: Column) -> Column:
    """Numeric value of a text cell, null when it does not parse."""
    return F.when(F.trim(text) != "", text.try_cast("double"))


def missing(col_name: str, dtype: str) -> Column:
    """Null test that also covers NaN in floating columns."""
    c = F.col(f"`{col_name}`")
    return c.isNull() | F.isnan(c) if dtype in ("double", "float") else c.isNull()


def nan_to_null(col_name: str, dtype: str) -> Column:
    """Column with NaN turned into null."""
    c = F.col(f"`{col_name}`")
    return F.when(~F.isnan(c), c) if dtype in ("double", "float") else c
