"""Gradient-boosted classifier of candidate pairs (Spark ML)."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES


@dataclass(frozen=True)
class Trees:
    """Parameters of the learner; LARGE is the high-capacity variant.

    Spark bounds a tree by its depth; ``leaves`` lowers the depth so far that no tree can have more leaves.
    """

    rounds: int = 500
    rate: float = 0.05
    depth: int = 7
    leaves: int = 45
    column_share: float = 0.8
    row_share: float = 1.0
    seed: int = 42


LARGE = Trees(rounds=750, rate=0.03, depth=9, leaves=63, column_share=0.7)


def train(labelled: DataFrame, p: Trees = Trees(), validation: str | None = None, tolerance: float = 0.01) -> PipelineModel:
    """Fit on FEATURES and ``label``; with a boolean column ``validation`` training stops when its rows improve no more."""
    gbt = GBTClassifier(labelCol="label", featuresCol="_features", maxIter=p.rounds, stepSize=p.rate, maxDepth=min(p.depth, p.leaves.bit_length() - 1), featureSubsetStrategy=str(p.column_share), subsamplingRate=p.row_share, seed=p.seed)
    if validation:
        gbt = gbt.setParams(validationIndicatorCol=validation, validationTol=tolerance)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    model = gbt.fit(assembler.transform(labelled.withColumn("label", F.col("label").cast("double"))))
    return PipelineModel([assembler, model])


def predict(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Pairs with ``prob``, the probability of a match."""
    out = model.transform(pairs)
    return out.withColumn("prob", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, n: int = 15) -> list[tuple[str, float]]:
    """The n most important features, scaled to a sum of 1 over all."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(FEATURES, values.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str | None) -> PipelineModel:
    """A saved model; there is no prediction without one."""
    if not path or (os.path.isabs(path) and not os.path.exists(path)):
        raise FileNotFoundError(f"no trained model at {path!r}")
    return PipelineModel.load(path)
