"""Supervised models: tree ensembles with sampling-correcting weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Depth of a forest's trees without a limit of their own: the most that pyspark.ml allows.
FOREST_DEPTH = 30


def training_weights(kind: str, label: str, weight: float, class_weight: str | None = None) -> Column:
    """Weight of a training row: undersampled rows of class 0 count ``weight`` times.

    Only a forest without class weights is corrected so; a boosted model gets
    the positives down-weighted by 1 / weight instead.
    """
    if kind == "forest":
        return F.when((F.col(label) == 0) & F.lit(class_weight is None), F.lit(float(weight))).otherwise(F.lit(1.0))
    if kind == "boost":
        return F.when(F.col(label) == 1, F.lit(1.0 / weight)).otherwise(F.lit(1.0))
    raise ValueError(f"unknown model {kind!r}")


def build(kind: str, params: Mapping, label: str = "Class", seed: int = 42):
    """The estimator for grid parameters."""
    if kind == "forest":
        return RandomForestClassifier(labelCol=label, weightCol="weight", seed=seed, numTrees=int(params.get("n_estimators") or 100), featureSubsetStrategy=str(params.get("max_features") or "sqrt"), subsamplingRate=float(params.get("max_samples") or 1.0), minInstancesPerNode=int(params.get("min_samples_leaf") or 1), maxDepth=int(params.get("max_depth") or FOREST_DEPTH))
    if kind == "boost":
        return GBTClassifier(labelCol=label, weightCol="weight", seed=seed, maxIter=int(params.get("n_estimators") or 100), maxDepth=int(params.get("max_depth") or 6), stepSize=float(params.get("learning_rate") or 0.1), minInfoGain=float(params.get("gamma") or 0.0))
    raise ValueError(f"unknown model {kind!r}")


def fit_predict(kind: str, params: Mapping, train: DataFrame, other: DataFrame, features: Sequence[str], label: str = "Class", weight: float = 1.0, class_weight: str | None = None) -> DataFrame:
    """Train on one part, add ``score`` and ``predicted`` to the other; rows with a null feature are skipped."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    w = training_weights(kind, label, weight, class_weight)
    if class_weight in ("balanced", "balanced_subsample"):
        n = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # one row per class
        w = F.when(F.col(label) == 1, sum(n.values()) / (2 * max(n.get(1, 0), 1))).otherwise(sum(n.values()) / (2 * max(n.get(0, 0), 1)))
    ready = assemble.transform(train.withColumn(label, F.col(label).cast("double")).withColumn("weight", w)).select("features", label, "weight")
    model = build(kind, params, label).fit(ready)
    scored = model.transform(assemble.transform(other))
    return scored.select(*other.columns, vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("predicted"))
