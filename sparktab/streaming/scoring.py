"""Scoring of a stream: stateless, so the batch operator applies as it is."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from sparktab.operators.estimators import NearestNeighbourModel
from sparktab.operators.scoring import score_table


def score_stream(model: PipelineModel, records: DataFrame) -> DataFrame:
    """Streaming records plus ``predicted`` and ``probability``.

    A neighbour search needs several passes over its records; score such a model from
    ``foreachBatch`` instead.
    """
    if any(isinstance(s, NearestNeighbourModel) for s in model.stages):
        raise ValueError("Nearest-neighbour models score batches only; use foreachBatch.")
    return score_table(model, records)
