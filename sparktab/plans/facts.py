"""What must hold for fitted models whatever the fit finds, as rows that SQL can state too.

Sizes of the held-out side per class, every reported metric recomputed from the confusion
matrix, probabilities recomputed from stored coefficients, sums and orders.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLOSE = 1e-9


def metrics_hold(row: dict) -> bool:
    """The metrics of a two-class payload follow from its confusion matrix; the others lie in their ranges."""
    (tn, fp), (fn, tp) = row["confusion_matrix"]
    share = lambda a, b: a / b if b else 0.0
    wanted = {
        "accuracy": share(tn + tp, tn + fp + fn + tp),
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
    }
    same = all(abs(row[name] - value) < CLOSE for name, value in wanted.items())
    return same and 0.5 < row["roc_auc"] <= 1 and 0 <= row["brier_score"] <= 1 and 0 <= row["log_loss"] < math.inf


def held_out(spark: SparkSession, measured: list[tuple[str, dict]]) -> DataFrame:
    """(model, label, n_test, metrics_hold, beats_majority) for each model and class."""
    rows = []
    for model, row in measured:
        sizes = [sum(line) for line in row["confusion_matrix"]]
        better = row["accuracy"] > max(sizes) / sum(sizes)
        rows += [(model, label, n, metrics_hold(row), better) for label, n in zip(row["labels"], sizes)]
    return spark.createDataFrame(rows, "model string, label string, n_test bigint, metrics_hold boolean, beats_majority boolean")


def in_order(values: list[float]) -> bool:
    return all(a >= b for a, b in zip(values, values[1:]))


def scored(model: PipelineModel, table: DataFrame, result: DataFrame, row_id: str) -> DataFrame:
    """(row_id, probability_holds, class_holds): the result's probability against the logistic function of the stored
    coefficients on the encoded features of ``table``, and the predicted class against the probability."""
    at = next(i for i, s in enumerate(model.stages) if isinstance(s, LogisticRegressionModel))
    fitted, classes = model.stages[at], model.stages[-1].value("classes")
    weights = F.array(*[F.lit(float(w)) for w in fitted.coefficients.toArray()])
    x = vector_to_array("features")
    margin = F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(float(fitted.intercept)), lambda a, b: a + b)
    encoded = PipelineModel(model.stages[:at]).transform(table).select(row_id, (1 / (1 + F.exp(-margin))).alias("wanted"))
    better = F.when(F.col("probability") > 0.5, F.lit(classes[1])).otherwise(F.lit(classes[0]))
    return result.join(encoded, row_id).select(
        row_id,
        (F.abs(F.col("probability") - F.col("wanted")) < CLOSE).alias("probability_holds"),
        (F.col("predicted") == better).alias("class_holds"),
    )
