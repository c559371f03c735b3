"""Result sets behind the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzfold.session import materialize


def mean_sd_best(df: DataFrame, metrics: Sequence[str], by: Sequence[str], digits: int = 3) -> DataFrame:
    """Mean and sample deviation per group and metric, and whether the rounded mean is the metric's best."""
    long = df.unpivot(list(by), list(metrics), "metric", "value").groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
    top = long.groupBy("metric").agg(F.max(F.round("mean", digits)).alias("top"))
    return long.join(top, "metric").select(*by, "metric", "mean", "deviation", F.coalesce(F.round("mean", digits) == F.col("top"), F.lit(False)).alias("best"))


def spread(df: DataFrame, metric: str, by: Sequence[str]) -> DataFrame:
    """Smallest, largest, median, mean, deviation and range of a metric per configuration."""
    m = F.col(metric)
    return df.groupBy(*by).agg(F.min(m).alias("least"), F.max(m).alias("most"), F.median(m).alias("median"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("deviation"), (F.max(m) - F.min(m)).alias("spread"))


def within_of_best(df: DataFrame, metric: str, by: Sequence[str], margin: float = 0.01) -> DataFrame:
    """Per group the best value and how many rows come within the margin of it."""
    best = df.groupBy(*by).agg(F.max(metric).alias("best"))
    return df.join(best, list(by)).groupBy(*by).agg(F.max("best").alias("best"), F.count_if(F.col(metric) >= F.col("best") - margin - 1e-12).alias("near_best"))


def adopt_rate(df: DataFrame, metrics: Sequence[str], rate: str, positives: str) -> DataFrame:
    """Metrics at another alert rate take the place of the main ones, which are kept as ``<metric>_at_main``."""
    missing = [m for m in metrics if f"{m}_at_{rate}" not in df.columns]
    if missing:
        raise ValueError(f"no column at rate {rate} for {missing}")
    kept = df.withColumns({f"{m}_at_main": F.col(m) for m in metrics})
    out = kept.withColumns({m: F.col(f"{m}_at_{rate}") for m in metrics})
    return out.withColumn("FN", F.col(positives) - F.col("TP")) if "TP" in metrics else out


def alert_curve(df: DataFrame, metrics: Sequence[str], rates: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean of the metrics per alert rate: (by, rate, metrics)."""
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), *[F.col(f"{m}_at_{r}").alias(m) for m in metrics]) for r in rates])).alias("x")
    return df.select(*by, rows).select(*by, "x.*").groupBy(*by, "rate").agg(*[F.avg(m).alias(m) for m in metrics])


def winners_by(df: DataFrame, metric: str, group: str, config: str) -> DataFrame:
    """Per group the configuration with the highest maximum and with the highest mean, ties by name."""
    g = df.groupBy(group, config).agg(F.max(metric).alias("top"), F.avg(metric).alias("mean"))
    w = lambda c: Window.partitionBy(group).orderBy(F.desc_nulls_last(F.round(c, 9)), config)
    return g.withColumns({"a": F.first(config).over(w("top")), "b": F.first(config).over(w("mean"))}).select(group, F.col("a").alias("by_max"), F.col("b").alias("by_mean")).distinct()


def report_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of a report whose ``fold`` is a number, as INT; other folds than 1 .. ``folds`` raise."""
    rows = df.withColumn("fold", F.col("fold").try_cast("int")).where("fold is not null")
    found = sorted(r[0] for r in rows.select("fold").distinct().collect())
    if found != list(range(1, folds + 1)):
        raise ValueError(f"the report has folds {found}")
    return rows


def check_rates(columns: Sequence[str], rates: Sequence[float], metrics: Sequence[str]) -> None:
    """Raises unless every metric has a column at every rate."""
    missing = [f"{m}_at_{r:g}" for r in rates for m in metrics if f"{m}_at_{r:g}" not in columns]
    if missing:
        raise ValueError(f"the report lacks {missing}")


def merge_stages(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of two stages side by side; a row that only one of them has, or has twice, raises."""
    joined = materialize(a.join(b, list(keys), "full"), "merged")
    n = joined.count()
    if not n == a.count() == b.count() or joined.select(*keys).distinct().count() != n:
        raise ValueError("the stages do not hold the same rows")
    return joined


def position(df: DataFrame, metric: str, by: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Adds ``place``: the position (from 1) within the group by falling metric, nulls last."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(metric), *ties)))


def decimal_text(column: str, digits: int = 3):
    """A number as text with a decimal comma; null stays null."""
    return F.translate(F.format_string(f"%.{digits}f", F.col(column)), ".", ",")
