"""Thresholds and classification metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfold.functions.ordering import running


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, predicted: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, TN with precision, recall and F1 (0 where undefined) per group."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    c = df.groupBy(*by).agg(F.count_if(p & y).alias("TP"), F.count_if(p & ~y).alias("FP"), F.count_if(~p & y).alias("FN"), F.count_if(~p & ~y).alias("TN"))
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def _by_score(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision over distinct scores; 0 without positives."""
    steps = running(_by_score(df, score, label, by), by, "score", ["pos", "neg"], descending=True)
    part = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return steps.groupBy(*by).agg(ratio(F.sum(part), F.sum("pos")).alias("average_precision"), F.sum("pos").alias("positives"))


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half; null without both classes."""
    steps = running(_by_score(df, score, label, by), by, "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return steps.groupBy(*by).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles per group: (by, quantiles). Nulls and NaN are left out.

    By running counts over distinct values, so no task holds a group's values.
    """
    known = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    g = known.groupBy(*by, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("n"))
    c = running(g, by, "__v", ["n"])
    total = c.groupBy(*by).agg(F.max("cum_n").alias("__all"))
    c = c.join(total, list(by)) if by else c.withColumn("__all", F.lit(total.first()[0]).cast("bigint"))
    ends = []
    for i, p in enumerate(probabilities):
        at = (F.col("__all") - 1) * F.lit(float(p))
        ends += [F.min(F.when(F.col("cum_n") > k, F.col("__v"))).alias(f"{n}{i}") for n, k in (("lo", F.floor(at)), ("hi", F.ceil(at)))]
    found = c.groupBy(*by).agg(F.first("__all").alias("__all"), *ends).where("__all is not null")
    between = []
    for i, p in enumerate(probabilities):
        at = (F.col("__all") - 1) * F.lit(float(p))
        between.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (at - F.floor(at)))
    return found.select(*by, F.array(*between).alias("quantiles"))


def quantile_threshold(df: DataFrame, score: str, rate: float, by: Sequence[str] = ()) -> DataFrame:
    """The (1 - rate) quantile of the scores, linearly interpolated."""
    return exact_quantiles(df, score, [1 - rate], by).select(*by, F.col("quantiles")[0].alias("threshold"))


def weighted_threshold(df: DataFrame, score: str, weight: str, rate: float, by: Sequence[str] = ()) -> DataFrame:
    """The smallest score whose cumulative weight reaches the share 1 - rate of all weight."""
    g = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(weight).alias("w"))
    c = running(g, by, "score", ["w"])
    if by:
        c = c.join(g.groupBy(*by).agg(F.sum("w").alias("total")), list(by))
    else:
        c = c.withColumn("total", F.lit(g.agg(F.sum("w")).first()[0]).cast("double"))
    return c.where(F.col("cum_w") >= F.col("total") * (1 - rate) - 1e-9).groupBy(*by).agg(F.min("score").alias("threshold"))


def fold_summary(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of every metric, a row per metric."""
    long = df.unpivot(list(by), list(metrics), "metric", "value") if by else df.select(*metrics).unpivot([], list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
