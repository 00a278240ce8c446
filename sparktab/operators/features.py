"""Feature preparation fitted on training rows: impute, scale, encode, assemble."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions.quantiles import exact_quantiles
from sparktab.functions.scalars import nan_to_null
from sparktab.operators.profile import category_lists, modes, numeric_columns


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    """Parameters that are plain JSON values, set and read by name."""

    def _fill(self, **values):
        return self._set(**values)

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))


class MedianModeImputer(_Stage, Estimator):
    """Exact median for numeric columns, most frequent value (smallest on ties) for others.

    Columns without any value are left out of the model and listed in ``dropped``.
    """

    numeric = Param(Params._dummy(), "numeric", "numeric columns")
    categorical = Param(Params._dummy(), "categorical", "other columns")

    @keyword_only
    def __init__(self, numeric=None, categorical=None):
        super().__init__()
        self._setDefault(numeric=[], categorical=[])
        self._fill(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MedianModeImputerModel:
        numeric, categorical = self.value("numeric"), self.value("categorical")
        medians = {c: q[0] for c, q in exact_quantiles(df, numeric, [0.5]).items()}
        top = modes(df, categorical)
        return MedianModeImputerModel(
            medians={c: v for c, v in medians.items() if v is not None},
            modes={c: v for c, v in top.items() if v is not None},
            dropped=[c for c, v in {**medians, **top}.items() if v is None],
        )


class MedianModeImputerModel(_Stage, Model):
    """Adds ``num__<column>`` doubles and ``cat__<column>`` texts without gaps."""

    medians = Param(Params._dummy(), "medians", "fill value per numeric column")
    modes = Param(Params._dummy(), "modes", "fill value per other column")
    dropped = Param(Params._dummy(), "dropped", "columns without any value")

    @keyword_only
    def __init__(self, medians=None, modes=None, dropped=None):
        super().__init__()
        self._setDefault(medians={}, modes={}, dropped=[])
        self._fill(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        types = dict(df.dtypes)
        added = {
            f"num__{c}": F.coalesce(nan_to_null(c, types[c]).cast("double"), F.lit(float(v)))
            for c, v in self.value("medians").items()
        }
        for c, v in self.value("modes").items():
            added[f"cat__{c}"] = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(v))
        return df.withColumns(added) if added else df


class PopulationScaler(_Stage, Estimator):
    """Zero mean, unit population standard deviation; a constant column keeps divisor 1."""

    columns = Param(Params._dummy(), "columns", "columns to scale in place")

    @keyword_only
    def __init__(self, columns=None):
        super().__init__()
        self._setDefault(columns=[])
        self._fill(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        columns = self.value("columns")
        if not columns:
            return PopulationScalerModel(means={}, scales={})
        exprs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(columns):
            x = F.col(f"`{c}`").cast("double")
            exprs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
        row = df.agg(*exprs).first()
        return PopulationScalerModel(
            means={c: row[f"m{i}"] for i, c in enumerate(columns)},
            scales={
                c: _divisor(row["n"], row[f"m{i}"], row[f"v{i}"]) for i, c in enumerate(columns)
            },
        )


def _divisor(n: int, mean: float, variance: float) -> float:
    """Standard deviation, or 1 where the spread is only rounding noise."""
    eps = 2.0**-52
    noise = min(n * eps, 0.5) * variance + (n * mean * eps) ** 2
    return 1.0 if variance <= noise else math.sqrt(variance)


class PopulationScalerModel(_Stage, Model):
    means = Param(Params._dummy(), "means", "mean per column")
    scales = Param(Params._dummy(), "scales", "divisor per column")

    @keyword_only
    def __init__(self, means=None, scales=None):
        super().__init__()
        self._setDefault(means={}, scales={})
        self._fill(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        scales = self.value("scales")
        scaled = {
            c: (F.col(f"`{c}`") - F.lit(float(m))) / F.lit(float(scales[c]))
            for c, m in self.value("means").items()
        }
        return df.withColumns(scaled) if scaled else df


class ClassDecoder(_Stage, Transformer):
    """Adds ``predicted``: the label value behind the class number in ``prediction``."""

    classes = Param(Params._dummy(), "classes", "labels in ascending order")
    labelType = Param(Params._dummy(), "labelType", "SQL type of the labels")

    @keyword_only
    def __init__(self, classes=None, labelType=None):
        super().__init__()
        self._fill(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        labels = F.array(*[F.lit(c) for c in self.value("classes")])
        place = F.col("prediction").cast("int") + 1
        label = F.element_at(labels, place).cast(self.value("labelType"))
        return df.withColumn("predicted", label)


def route_columns(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical features by type; nested and time columns are refused."""
    numeric = [c for c in numeric_columns(df) if c in features]
    categorical = []
    for c in features:
        if c in numeric:
            continue
        kind = df.schema[c].dataType
        if not isinstance(kind, (T.StringType, T.BooleanType, T.DateType)):
            raise ValueError(f"Column {c} of type {kind.simpleString()} cannot be a feature.")
        categorical.append(c)
    return numeric, categorical


def build_encoder(df: DataFrame, features: list[str], scale: bool = True) -> TableEncoder:
    """Unfitted encoder from raw features to the ``features`` vector."""
    numeric, categorical = route_columns(df, features)
    return TableEncoder(numeric=numeric, categorical=categorical, scale=scale)


class TableEncoder(_Stage, Estimator):
    """Impute, scale, one-hot encode and assemble, fitted in three passes.

    One pass takes counts and moments, one the medians, one the category lists. The
    moments after imputation follow from those before it, so scaling costs no pass of
    its own. Columns without any value are left out.
    """

    numeric = Param(Params._dummy(), "numeric", "numeric columns")
    categorical = Param(Params._dummy(), "categorical", "other columns")
    scale = Param(Params._dummy(), "scale", "whether numeric columns are scaled")

    @keyword_only
    def __init__(self, numeric=None, categorical=None, scale=True):
        super().__init__()
        self._setDefault(numeric=[], categorical=[], scale=True)
        self._fill(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        numeric, categorical = self.value("numeric"), self.value("categorical")
        types = dict(df.dtypes)
        exprs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(numeric):
            x = nan_to_null(c, types[c]).cast("double")
            exprs += [F.count(x).alias(f"k{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
        row = df.agg(*exprs).first()
        counts = {c: row[f"k{i}"] for i, c in enumerate(numeric)}
        medians = {c: q[0] for c, q in exact_quantiles(df, numeric, [0.5], counts=counts).items()}
        labels, top = category_lists(df, categorical)
        fills = {c: v for c, v in medians.items() if v is not None}
        imputer = MedianModeImputerModel(
            medians=fills, modes=top, dropped=[c for c in numeric + categorical if c not in fills | top]
        )
        stages: list = [imputer]
        if self.value("scale") and fills:
            means, scales = {}, {}
            for i, c in enumerate(numeric):
                if c in fills:
                    n, k, mean, var = row["n"], row[f"k{i}"], row[f"m{i}"], row[f"v{i}"]
                    whole = (k * mean + (n - k) * fills[c]) / n
                    spread = k * (var + (mean - whole) ** 2) + (n - k) * (fills[c] - whole) ** 2
                    means[f"num__{c}"] = whole
                    scales[f"num__{c}"] = _divisor(n, whole, spread / n)
            stages.append(PopulationScalerModel(means=means, scales=scales))
        cat = [f"cat__{c}" for c in categorical if c in top]
        if cat:
            indexers = [
                StringIndexerModel.from_labels(
                    labels[c[5:]], inputCol=c, outputCol=f"{c}__index", handleInvalid="keep"
                )
                for c in cat
            ]
            encoder = OneHotEncoder(
                inputCols=[f"{c}__index" for c in cat],
                outputCols=[f"{c}__slots" for c in cat],
                dropLast=True,
            )
            indexed = PipelineModel([imputer, *indexers]).transform(df)
            stages += [*indexers, encoder.fit(indexed)]
        inputs = [f"num__{c}" for c in fills] + [f"{c}__slots" for c in cat]
        return PipelineModel([*stages, VectorAssembler(inputCols=inputs, outputCol="features")])


def slot_table(encoder: PipelineModel) -> list[tuple[int, str, str]]:
    """(slot, name, base column) of the ``features`` vector, read from the fitted stages."""
    assembler = encoder.stages[-1]
    labels = {}
    for stage in encoder.stages:
        if isinstance(stage, StringIndexerModel):
            labels[stage.getInputCol()] = stage.labels
    slots = []
    for col in assembler.getInputCols():
        if col.startswith("num__"):
            slots.append((len(slots), col, col[5:]))
        else:
            source = col[: -len("__slots")]
            for value in labels[source]:
                slots.append((len(slots), f"{source}_{value}", source[5:]))
    return slots
