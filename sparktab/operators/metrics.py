"""Classification metrics and curves as DataFrame aggregations.

A scored table has a label, a prediction of the same type and, where the model gives
one, ``probability``: one share per class in ascending class order. Everything that
needs rows is folded into counts per (label, prediction) or per score first; the rules
then run on those small tables.
"""

from __future__ import annotations

import math
import sys

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.session import combine_single_rows, cut_lineage

SCORES_PER_BUCKET = 250_000


def confusion_counts(scored: DataFrame, label: str = "label", prediction: str = "prediction"):
    """(label, prediction, n) for the pairs that occur."""
    return scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def summary(counts: DataFrame) -> DataFrame:
    """One row with everything that follows from confusion counts.

    ``truth`` holds the true labels, ``axis`` the union of true and predicted ones,
    ``matrix`` the dense counts over ``axis``. Loss sums in ``counts`` are added up.
    """
    losses = [c for c in ("n_log", "log_sum", "square_sum") if c in counts.columns]
    lines = counts.groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.struct("prediction", "n"))).alias("line"),
        *[F.sum(c).alias(c) for c in losses],
    )
    row = lines.agg(
        F.map_from_entries(F.collect_list(F.struct("label", "line"))).alias("lines"),
        *[F.sum(c).alias(c) for c in losses],
    )
    seen = F.flatten(F.transform(F.map_values("lines"), F.map_keys))
    row = row.select(
        "*",
        F.array_sort(F.map_keys("lines")).alias("truth"),
        F.array_sort(F.array_union(F.map_keys("lines"), seen)).alias("axis"),
    )
    none = F.lit(0).cast("bigint")
    row = row.withColumn(
        "matrix",
        F.transform(
            "axis",
            lambda t: F.transform(
                "axis",
                lambda p: F.coalesce(
                    F.try_element_at(F.try_element_at("lines", t), p), none
                ),
            ),
        ),
    )
    places = F.sequence(F.lit(0), F.size("axis") - 1)
    sums = row.select(
        "*",
        F.transform("matrix", _sum_long).alias("support"),
        F.transform(
            places, lambda j: _sum_long(F.transform("matrix", lambda line: F.get(line, j)))
        ).alias("predicted"),
        F.transform("matrix", lambda line, i: F.get(line, i)).alias("tp"),
    )
    return sums.withColumn("n", _sum_long(F.col("support")))


def _sum_long(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _ratios(top: Column, bottom: Column) -> Column:
    """Elementwise division where 0/0 counts as 0."""
    return F.zip_with(top, bottom, lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)))


def _class_rates() -> dict[str, Column]:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return {
        "precision": _ratios(tp, predicted),
        "recall": _ratios(tp, support),
        "f1": _ratios(
            F.transform(tp, lambda x: 2 * x), F.zip_with(support, predicted, lambda a, b: a + b)
        ),
    }


def _headline() -> list[Column]:
    """Exactly two true labels: the greater one is positive. Otherwise plain means."""
    accuracy = _sum_long(F.col("tp")) / F.col("n")
    positive = F.array_position("axis", F.array_max("truth")).cast("int")
    return [
        accuracy.alias("accuracy"),
        (1 - accuracy).alias("error_rate"),
        *[
            F.when(F.size("truth") == 2, F.element_at(rates, positive))
            .otherwise(_mean(rates))
            .alias(name)
            for name, rates in _class_rates().items()
        ],
    ]


def _ordinal() -> list[Column]:
    """Errors of label indices; null if a predicted label is never true."""
    known = F.size("axis") == F.size("truth")

    def moment(power) -> Column:
        weighted = F.transform(
            "matrix",
            lambda line, i: F.aggregate(
                F.transform(line, lambda n, j: n * power(i - j)), F.lit(0.0), lambda a, x: a + x
            ),
        )
        return F.when(known, F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x) / F.col("n"))

    mse = moment(lambda d: d * d)
    return [moment(F.abs).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse")]


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction"):
    """Dense (label, prediction, n) over the union of true and predicted labels."""
    lines = summary(confusion_counts(scored, label, prediction)).select(
        "axis", F.posexplode("matrix").alias("i", "line")
    )
    cells = lines.select("axis", "i", F.posexplode("line").alias("j", "n"))
    return cells.select(
        F.get("axis", F.col("i")).alias("label"), F.get("axis", F.col("j")).alias("prediction"), "n"
    )


def confusion_cells(scored: DataFrame, label: str = "label", prediction: str = "prediction"):
    """(cell, value) with TN, FP, FN, TP; empty unless there are exactly two labels."""
    names = F.array(*[F.lit(x) for x in ("TN", "FP", "FN", "TP")])
    two = summary(confusion_counts(scored, label, prediction)).where(F.size("axis") == 2)
    return two.select(F.posexplode(F.flatten("matrix")).alias("place", "value")).select(
        F.get(names, F.col("place")).alias("cell"), "value"
    )


def classification_metrics(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: accuracy, error rate, precision, recall, F1 by the averaging rule."""
    return headline(confusion_counts(scored, label, prediction))


def headline(counts: DataFrame) -> DataFrame:
    """``classification_metrics`` of confusion counts."""
    return summary(counts).select(*_headline())


def macro_metrics(counts: DataFrame) -> DataFrame:
    """One row of unweighted means over the union of labels."""
    rates = _class_rates()
    return summary(counts).select(*[_mean(r).alias(f"{name}_macro") for name, r in rates.items()])


def ordinal_errors(counts: DataFrame) -> DataFrame:
    """MAE, MSE, RMSE on label indices; null if a predicted label is never true."""
    return summary(counts).select(*_ordinal())


def class_index(label: Column, classes: list) -> Column:
    """1-based place of a label in the class list, null when it is not there."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    return F.when(place > 0, place.cast("int"))


def _row_losses(classes: list, label: str, probability: str) -> tuple[Column, Column]:
    eps = sys.float_info.epsilon
    place = class_index(F.col(label), classes)
    p_true = F.element_at(F.col(probability), place)
    clipped = F.least(F.greatest(p_true, F.lit(eps)), F.lit(1 - eps))
    log_term = F.when(p_true.isNotNull(), -F.log(clipped))
    if len(classes) == 2:
        diff = F.element_at(F.col(probability), 2) - (place - 1)
        square = diff * diff
    else:
        square = F.lit(None).cast("double")
    return log_term, square


def probability_losses(
    scored: DataFrame, classes: list, label: str = "label", probability: str = "probability"
) -> DataFrame:
    """One row: log loss over all classes, Brier score for two classes."""
    log_term, square = _row_losses(classes, label, probability)
    return scored.agg(
        F.when(F.count(log_term) == F.count(F.lit(1)), F.avg(log_term)).alias("log_loss"),
        F.avg(square).alias("brier_score"),
    )


def _score_counts(rows: DataFrame, group: Column, score: Column, positive: Column) -> DataFrame:
    """(grp, score, pos, neg, bucket) with rows folded per score and scores cut into buckets.

    Scores are folded before any ordering, so a score shared by many rows costs
    nothing; the fold is checkpointed, so ``rows`` are read once. The number of buckets
    grows with the folded rows. The cut points come from a sketch and are plain
    constants, which keeps the bucket of a score the same in every use. Buckets rise with the scores; a null score is
    below all others and NaN above.
    """
    flat = rows.select(
        group.alias("grp"), score.cast("double").alias("score"), positive.alias("positive")
    )
    folded = cut_lineage(
        flat.groupBy("grp", "score").agg(
            F.count_if(F.col("positive")).alias("pos"), F.count_if(~F.col("positive")).alias("neg")
        )
    )
    buckets = max(1, math.ceil(folded.count() / SCORES_PER_BUCKET))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = folded.agg(F.percentile_approx("score", shares, 4 * buckets)).first()[0] if shares else []
    splits = [-math.inf, *sorted({0.0, *(c for c in cuts or [] if math.isfinite(c))}), math.inf]
    cutter = Bucketizer(splits=splits, inputCol="_score", outputCol="bucket", handleInvalid="keep")
    placed = cutter.transform(folded.withColumn("_score", F.coalesce("score", F.lit(0.0))))
    return placed.withColumn(
        "bucket", F.when(F.col("score").isNull(), F.lit(-1.0)).otherwise(F.col("bucket"))
    ).drop("_score")


def auc_by_group(rows: DataFrame, group: Column, score: Column, positive: Column) -> DataFrame:
    """(grp, auc): share of (positive, negative) pairs ordered right, ties half."""
    counts = _score_counts(rows, group, score, positive)
    below = Window.partitionBy("grp", "bucket").orderBy("score").rowsBetween(
        Window.unboundedPreceding, -1
    )
    neg_below = F.coalesce(F.sum("neg").over(below), F.lit(0))
    wins = F.col("pos").cast("double") * (neg_below + F.col("neg") / 2)
    buckets = (
        counts.withColumn("wins", wins)
        .groupBy("grp", "bucket")
        .agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "wins")])
    )
    lower = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("neg").over(lower), F.lit(0))
    return (
        buckets.withColumn("wins", F.col("wins") + F.col("pos").cast("double") * before)
        .groupBy("grp")
        .agg(
            F.try_divide(
                F.sum("wins"), F.sum("pos").cast("double") * F.sum("neg").cast("double")
            ).alias("auc")
        )
    )


def roc_auc(
    scored: DataFrame, classes: list, label: str = "label", probability: str = "probability"
) -> DataFrame:
    """One row ``roc_auc``: binary on the greater class, else one-vs-rest mean.

    Null where a class is absent from the labels or has no counterpart.
    """
    if len(classes) == 2:
        score = F.element_at(F.col(probability), 2)
        per = auc_by_group(scored, F.lit(1), score, F.col(label) == F.lit(classes[1]))
    else:
        long = scored.select(
            class_index(F.col(label), classes).alias("truth"),
            F.posexplode(F.col(probability)).alias("place", "score"),
        )
        per = auc_by_group(
            long, F.col("place"), F.col("score"), F.col("truth") == F.col("place") + 1
        )
    return per.agg(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("roc_auc"))


def curve_points(scored: DataFrame, score: Column, positive: Column) -> DataFrame:
    """(threshold, tp, fp, pos_total, neg_total) for each distinct score."""
    counts = _score_counts(scored, F.lit(1), score, positive)
    inside = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    points = counts.select(
        "bucket",
        F.col("score").alias("threshold"),
        F.sum("pos").over(inside).alias("tp"),
        F.sum("neg").over(inside).alias("fp"),
    )
    sums = counts.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    everything = Window.partitionBy(F.lit(1))
    higher = everything.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "bucket",
        F.coalesce(F.sum("bp").over(higher), F.lit(0)).alias("tp0"),
        F.coalesce(F.sum("bn").over(higher), F.lit(0)).alias("fp0"),
        F.sum("bp").over(everything).alias("pos_total"),
        F.sum("bn").over(everything).alias("neg_total"),
    )
    # One row for each SCORES_PER_BUCKET scores; the plan broadcasts it only while it is small.
    return (
        points.join(offsets, "bucket")
        .select(
            "threshold",
            (F.col("tp") + F.col("tp0")).alias("tp"),
            (F.col("fp") + F.col("fp0")).alias("fp"),
            "pos_total",
            "neg_total",
        )
    )


def roc_curve(scored: DataFrame, score: Column, positive: Column) -> DataFrame:
    """(threshold, fpr, tpr), with the origin as a null threshold."""
    points = curve_points(scored, score, positive).select(
        "threshold",
        (F.col("fp") / F.col("neg_total")).alias("fpr"),
        (F.col("tp") / F.col("pos_total")).alias("tpr"),
    )
    origin = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def pr_curve(scored: DataFrame, score: Column, positive: Column) -> DataFrame:
    """(threshold, precision, recall), with the end point (1, 0) as a null threshold."""
    points = curve_points(scored, score, positive).select(
        "threshold",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("pos_total")).alias("recall"),
    )
    end = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def metric_payload(
    scored: DataFrame,
    classes: list,
    label: str = "label",
    prediction: str = "prediction",
    probability: str | None = "probability",
) -> DataFrame:
    """The full metric set as one row.

    One pass folds the rows into counts and loss sums per (label, prediction), on which
    all rules run; a second one orders the folded scores for the AUC.
    """
    if probability is None:
        losses = (F.lit(None).cast("double"), F.lit(None).cast("double"))
    else:
        losses = _row_losses(classes, label, probability)
    sums = scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(losses[0]).alias("n_log"),
        F.sum(losses[0]).alias("log_sum"),
        F.sum(losses[1]).alias("square_sum"),
    )
    known = F.size("axis") == F.size("truth")
    row = summary(sums).select(
        *_headline(),
        *_ordinal(),
        F.when(known & (F.col("n_log") == F.col("n")), F.col("log_sum") / F.col("n")).alias("log_loss"),
        F.when(known & (F.size("truth") == 2), F.col("square_sum") / F.col("n")).alias("brier_score"),
        F.col("matrix").alias("confusion_matrix"),
    )
    if probability is None:
        row = row.withColumn("roc_auc", F.lit(None).cast("double"))
    else:
        row = combine_single_rows(row, roc_auc(scored, classes, label, probability))
    return row.withColumn("labels", F.array(*[F.lit(c) for c in classes]))
