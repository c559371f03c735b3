"""Scoring a stream of transactions against a frozen fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.operators.features import Scaler


def score_stream(stream: DataFrame, scaler: Scaler, threshold: float) -> DataFrame:
    """Adds ``score``, the distance from the training centre, and ``alert``; stateless, works on batches too."""
    parts = [F.pow((F.col(c) - m) / s, 2) for c, m, s in zip(scaler.columns, scaler.location, scaler.scale)]
    scored = stream.withColumn("score", F.sqrt(sum(parts, F.lit(0.0))))
    return scored.withColumn("alert", F.coalesce((F.col("score") >= threshold).cast("int"), F.lit(0)))


def alerts_per_window(scored: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Transactions and alerts per tumbling window; rows later than the watermark are dropped."""
    w = scored.withWatermark(time, late).groupBy(F.window(time, window))
    return w.agg(F.count("*").alias("n"), F.sum("alert").alias("alerts")).select(F.col("window.start").alias("start"), "n", "alerts")
