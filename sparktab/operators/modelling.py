"""Fit, score and measure one model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.operators import metrics
from sparktab.operators.estimators import fit_classifier
from sparktab.operators.features import ClassDecoder, build_encoder
from sparktab.operators.prep import ROW_ID, feature_columns
from sparktab.session import cut_lineage, store


def with_class_number(df: DataFrame, target: str, classes: list) -> DataFrame:
    """Add ``label``: the class's place in the ascending class list, as double."""
    return df.withColumn(
        "label", (metrics.class_index(F.col(target), classes) - 1).cast("double")
    )


def encoded(df: DataFrame, encoder: PipelineModel, row_id: str, target: str) -> DataFrame:
    """Row id, target, class number and features: all a fit needs."""
    return encoder.transform(df).select(row_id, target, "label", "features")


def stored_encoded(parts: list[DataFrame], encoder: PipelineModel, row_id: str, target: str) -> tuple[list[DataFrame], list[str]]:
    """Every part encoded once and stored for the fits that read it many times; the tables and where they are."""
    tables, paths = zip(*[store(encoded(part, encoder, row_id, target), "encoded") for part in parts])
    return list(tables), list(paths)


def fit_model(
    train: DataFrame,
    target: str,
    classes: list,
    algorithm: str,
    params: dict | None = None,
    row_id: str = ROW_ID,
    scale: bool = True,
) -> PipelineModel:
    """Encoder, classifier and class decoder fitted on training rows only."""
    train = with_class_number(train, target, classes)
    encoder = build_encoder(train, feature_columns_of(train, target, row_id), scale).fit(train)
    data = encoded(train, encoder, row_id, target).persist()
    try:
        stages = fit_classifier(algorithm, data, len(classes), params, row_id)
    finally:
        data.unpersist()
    return assemble(encoder, stages, classes, train.schema[target].dataType.simpleString())


def assemble(
    encoder: PipelineModel, stages: list, classes: list, label_type: str
) -> PipelineModel:
    decoder = ClassDecoder(classes=classes, labelType=label_type)
    return PipelineModel([*encoder.stages, *stages, decoder])


def feature_columns_of(df: DataFrame, target: str, row_id: str) -> list[str]:
    return [c for c in feature_columns(df, target, row_id) if c != "label"]


def model_classes(model: PipelineModel) -> list:
    return model.stages[-1].value("classes")


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Input columns plus ``predicted`` and, per class, ``probability``."""
    scored = model.transform(df)
    return scored.select(
        *df.columns, "predicted", vector_to_array("probability").alias("probability")
    )


def measure(
    model: PipelineModel, test: DataFrame, target: str, row_id: str = ROW_ID
) -> DataFrame:
    """The full metric payload of a model on held-out rows, as one row."""
    scored = score(model, test).select(row_id, target, "predicted", "probability").persist()
    try:
        row = metrics.metric_payload(
            scored, model_classes(model), target, "predicted", "probability"
        )
        row = cut_lineage(row)
    finally:
        scored.unpersist()
    return row
