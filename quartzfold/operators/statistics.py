"""Descriptive statistics and two-sample comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzfold.functions.ordering import running
from quartzfold.operators.features import covariance


def ks_two_sample(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Kolmogorov-Smirnov D and approximate p-value per column, rows of ``group`` 0 against 1: (feature, d, p_value)."""
    long = df.where(F.col(group).isin(0, 1)).select(group, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([group], list(columns), "feature", "value").where("value is not null")
    g = long.groupBy("feature", "value").agg(F.count_if(F.col(group) == 0).alias("a"), F.count_if(F.col(group) == 1).alias("b"))
    c = running(g, ["feature"], "value", ["a", "b"])
    n = g.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    d = c.join(n, "feature").where("na > 0 and nb > 0").groupBy("feature").agg(F.max(F.abs(F.col("cum_a") / F.col("na") - F.col("cum_b") / F.col("nb"))).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    root = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    t = (root + 0.12 + 0.11 / root) * F.col("d")
    tail = sum(((-1) ** (k - 1) * F.exp(-2 * k * k * t * t) for k in range(1, 31)), F.lit(0.0)) * 2
    return d.select("feature", "d", F.when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))).alias("p_value"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, over rows without nulls in the columns: (a, b, r)."""
    _, cov, _ = covariance(df, columns)
    s = np.sqrt(np.diag(cov))
    rows = [(a, b, float(cov[i, j] / (s[i] * s[j])) if s[i] > 0 and s[j] > 0 else None) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the rank of the column, ties sharing their mean; null for null."""
    g = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("n"))
    ranks = running(g, [], "__v", ["n"]).select("__v", (F.col("cum_n") - (F.col("n") - 1) / 2).alias(name))
    return df.withColumn("__v", F.col(column).cast("double")).join(ranks, "__v", "left").drop("__v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation over rows with both values: one row (n, rho)."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_ranks(average_ranks(known, a, "__ra"), b, "__rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("__ra", "__rb").alias("rho"))


def discriminative_power(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Average precision of each feature in its better direction: (feature, average_precision, direction, lift).

    One running sum over each feature's values serves both directions: what is
    above a value is the total less what is below it.
    """
    long = df.where(F.col(label).isNotNull()).select(label, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([label], list(columns), "feature", "value").where("value is not null")
    g = long.groupBy("feature", "value").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    c = running(g, ["feature"], "value", ["pos", "neg"])
    c = c.join(g.groupBy("feature").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")), "feature")
    over_p, over_n = F.col("p") - F.col("cum_pos") + F.col("pos"), F.col("n") - F.col("cum_neg") + F.col("neg")
    ap = lambda p, n: F.coalesce(F.try_divide(F.sum(F.col("pos") * p / (p + n)), F.max("p")), F.lit(0.0))
    both = c.groupBy("feature").agg(ap(over_p, over_n).alias("high"), ap(F.col("cum_pos"), F.col("cum_neg")).alias("low"), F.max("p").alias("p"), F.max("n").alias("n"))
    best = both.withColumn("m", F.greatest(F.struct(F.round("high", 9).alias("ap"), F.lit(1).alias("direction")), F.struct(F.round("low", 9).alias("ap"), F.lit(-1).alias("direction"))))
    return best.select("feature", F.col("m.ap").alias("average_precision"), F.col("m.direction").alias("direction"), F.try_divide("m.ap", F.col("p") / (F.col("p") + F.col("n"))).alias("lift"))


def histogram(df: DataFrame, column: str, by: str, low: float, high: float, bins: int) -> DataFrame:
    """Share of each group's values per bin, the last bin closed on the right: (by, bin, n, share)."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    c = df.where(F.col(column).between(low, high) & F.col(by).isNotNull()).groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))
    total = c.groupBy(by).agg(F.sum("n").alias("__t"))
    return c.join(total, by).select(by, "bin", "n", (F.col("n") / F.col("__t")).alias("share"))


def kde(df: DataFrame, column: str, by: str, grid: Sequence[float]) -> DataFrame:
    """Gaussian kernel density per group at fixed points, bandwidth by Scott's rule: (by, x, density)."""
    known = df.where(F.col(column).isNotNull() & F.col(by).isNotNull()).select(by, F.col(column).cast("double").alias("v"))
    s = known.groupBy(by).agg(F.count("*").alias("n"), (F.stddev_samp("v") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h")).where("h > 0")
    at = known.groupBy(by, "v").agg(F.count("*").alias("w")).join(s, by).select(by, "v", "w", "n", "h", F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("x"))
    k = F.exp(-F.pow((F.col("x") - F.col("v")) / F.col("h"), 2) / 2) / math.sqrt(2 * math.pi)
    return at.groupBy(by, "x").agg((F.sum(k * F.col("w")) / F.first("n") / F.first("h")).alias("density"))


def kde_plane(df: DataFrame, x: str, y: str, by: str, points: Sequence[tuple[float, float]]) -> DataFrame:
    """Gaussian kernel density of two columns per group at fixed points: (by, px, py, density).

    The kernel has the group's covariance, scaled by Scott's rule for two dimensions.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(by).isNotNull()).select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = known.groupBy(by).agg(F.count("*").alias("n"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy"))
    s = s.withColumn("h2", F.pow(F.col("n").cast("double"), F.lit(-1 / 3))).withColumn("det", F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")).where("det > 0")
    at = known.groupBy(by, "x", "y").agg(F.count("*").alias("w")).join(s, by)
    at = at.withColumn("z", F.explode(F.array(*[F.struct(F.lit(float(a)).alias("px"), F.lit(float(b)).alias("py")) for a, b in points])))
    u, v = F.col("z.px") - F.col("x"), F.col("z.py") - F.col("y")
    q = (F.col("yy") * u * u - 2 * F.col("xy") * u * v + F.col("xx") * v * v) / F.col("det")
    k = F.exp(-q / F.col("h2") / 2) * F.col("w")
    return at.groupBy(by, F.col("z.px").alias("px"), F.col("z.py").alias("py")).agg((F.sum(k) / (2 * math.pi * F.first("n") * F.first("h2") * F.sqrt(F.first("det")))).alias("density"))


def density_levels(density: DataFrame, by: str) -> DataFrame:
    """Adds ``level``: the share of the group's density in points at least as dense, so a point lies in the region of every larger level."""
    w = Window.partitionBy(by)
    down = w.orderBy(F.desc("density"), "px", "py").rowsBetween(Window.unboundedPreceding, 0)
    # A group has one row per point of the fixed grid.
    return density.withColumn("level", F.sum("density").over(down) / F.sum("density").over(w))


def region_share(rows: DataFrame, levels: DataFrame, by: str, step: float, wanted: Sequence[float]) -> DataFrame:
    """Share of all rows (px, py) whose nearest grid point lies in each group's region of each level: (by, region, points, share)."""
    at = rows.select((F.round(F.col("px") / step) * step).alias("px"), (F.round(F.col("py") / step) * step).alias("py")).groupBy("px", "py").agg(F.count("*").alias("n"))
    total = rows.count()
    z = levels.join(at, ["px", "py"], "left").withColumn("region", F.explode(F.array(*[F.lit(float(v)) for v in wanted])))
    inside = F.col("level") <= F.col("region")
    return z.groupBy(by, "region").agg(F.count_if(inside).alias("points"), (F.sum(F.when(inside, F.coalesce("n", F.lit(0))).otherwise(0)) / F.lit(max(total, 1))).alias("share"))


def t_tail(t: float, degrees: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t):
        return 0.0
    a, b, x = degrees / 2, 0.5, degrees / (degrees + t * t)
    if x >= 1:
        return 1.0

    def fraction(a, b, x):
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation by the t distribution; 0 for a perfect one, NaN below 3 rows."""
    if n < 3:
        return math.nan
    return 0.0 if abs(rho) >= 1 else t_tail(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def density_regions(reference: np.ndarray, density: np.ndarray, levels: Sequence[float]) -> np.ndarray:
    """Number of highest-density regions that do not hold a point, by the (1 - level) quantiles of the reference's density."""
    cuts = np.quantile(reference, [1 - l for l in levels])
    return (cuts[None] > np.asarray(density)[:, None]).sum(1)
