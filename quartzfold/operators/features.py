"""Feature expressions, scaling and whitening, fitted on a training part only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfold.functions.ordering import hash_rank
from quartzfold.operators.evaluation import exact_quantiles
from quartzfold.sources.tables import V_COLUMNS

DERIVED = ["log_amount", "hour_sin", "hour_cos"]
#: Tasks that join the partitions' Gram matrices.
JOINS = 16


def hour(time: str = "Time") -> Column:
    """Hour of the day, with fractions, from seconds."""
    return F.pmod(F.col(time), F.lit(86400)) / 3600


def derive(df: DataFrame, excluded: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """V1 .. V28, ln(1 + Amount) and the hour on the circle, without the excluded; ``keep`` passes through."""
    angle = hour() * (2 * math.pi / 24)
    made = {"log_amount": F.log1p("Amount"), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle)}
    unknown = set(excluded) - set(DERIVED) - set(V_COLUMNS)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    return df.select(*keep, *[c for c in V_COLUMNS if c not in excluded], *[e.alias(c) for c, e in made.items() if c not in excluded])


@dataclass(frozen=True)
class Scaler:
    """Location and scale per column, from one aggregation over the training part."""

    columns: tuple[str, ...]
    location: tuple[float, ...]
    scale: tuple[float, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        """Scaled columns first, all others after them, unchanged."""
        rest = [c for c in df.columns if c not in self.columns]
        scaled = [((F.col(c) - m) / s).alias(c) for c, m, s in zip(self.columns, self.location, self.scale)]
        return df.select(*scaled, *rest)


def _fit(df: DataFrame, columns: Sequence[str], location, scale) -> Scaler:
    r = df.agg(*[location(c).alias(f"m_{c}") for c in columns], *[scale(c).alias(f"s_{c}") for c in columns]).first()
    k = len(columns)
    fill = lambda x, d: d if x is None or x != x else float(x)
    return Scaler(tuple(columns), tuple(fill(x, 0.0) for x in r[:k]), tuple(fill(x, 1.0) or 1.0 for x in r[k:]))


def standard_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    """z-scores with the population deviation; a constant column is only centred."""
    return _fit(train, columns, F.avg, F.stddev_pop)


def robust_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    """Median and interquartile range, both exact; a column without spread is only centred."""
    location, scale = [], []
    for c in columns:
        r = exact_quantiles(train, c, [0.25, 0.5, 0.75]).first()
        q = r[0] if r else [0.0, 0.0, 0.0]
        location.append(q[1])
        scale.append((q[2] - q[0]) or 1.0)
    return Scaler(tuple(columns), tuple(location), tuple(scale))


def centre_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    """The mean is subtracted."""
    return _fit(train, columns, F.avg, lambda c: F.lit(1.0))


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and number of rows without nulls, by one pass over partial Gram matrices.

    Means and centred products are joined pairwise, so large means cost no digits.
    """
    p = len(columns)

    def gram(batches):
        n, mean, m2 = 0, np.zeros(p), np.zeros((p, p))
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)])
            x = x[~np.isnan(x).any(1)]
            if len(x):
                m, k = x.mean(0), len(x)
                d = m - mean
                m2 += (x - m).T @ (x - m) + np.outer(d, d) * n * k / (n + k)
                mean += d * k / (n + k)
                n += k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([m2.ravel().tolist()])], names=["n", "mean", "m2"])

    def joined(rows):
        n, mean, m2 = 0, np.zeros(p), np.zeros((p, p))
        for k, m, g in rows:
            d = np.asarray(m) - mean
            m2 += np.asarray(g).reshape(p, p) + np.outer(d, d) * n * k / (n + k)
            mean += d * k / (n + k)
            n += k
        return n, mean, m2

    def join(batches):
        n, mean, m2 = joined(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([m2.ravel().tolist()])], names=["n", "mean", "m2"])

    # One small row per partition, joined in JOINS tasks before the driver joins the rest.
    schema = "n bigint, mean array<double>, m2 array<double>"
    parts = df.select(*columns).mapInArrow(gram, schema).where("n > 0").repartition(JOINS).mapInArrow(join, schema).where("n > 0")
    n, mean, m2 = joined((r["n"], r["mean"], r["m2"]) for r in parts.collect())
    return mean, m2 / max(n - 1, 1), n


def chi2_quantile(q: float, p: int) -> float:
    """Quantile of the chi-squared distribution with p degrees of freedom, by bisection of its series."""

    def cdf(x: float) -> float:
        a, t = p / 2, x / 2
        term = math.exp(-t + a * math.log(t) - math.lgamma(a + 1)) if t > 0 else 0.0
        total, k = term, 1
        while term > 1e-17 * max(total, 1e-300) and k < 10_000:
            term *= t / (a + k)
            total += term
            k += 1
        return total

    lo, hi = 0.0, p + 40 * math.sqrt(2 * p) + 40
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < q else (lo, mid)
    return (lo + hi) / 2


@dataclass(frozen=True)
class Whitener:
    """(x - mean) W with W W' the inverse covariance: Euclidean distance becomes Mahalanobis distance."""

    columns: tuple[str, ...]
    mean: np.ndarray
    matrix: np.ndarray
    floored: int

    def apply(self, df: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
        """The kept columns, ``vector`` and its ``distance`` from the centre; null where a feature is null."""
        mean, matrix, k = self.mean, self.matrix, len(keep)
        schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", vector array<double>, distance double"

        def run(batches):
            for b in batches:
                x = np.column_stack([b.column(k + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(mean))])
                z = (x - mean) @ matrix
                bad = np.isnan(z).any(1)
                v = pa.array([None if n else r for n, r in zip(bad, z.tolist())], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(k)], v, pa.array(np.sqrt((z**2).sum(1)), mask=bad)], names=[*keep, "vector", "distance"])

        return df.select(*keep, *self.columns).mapInArrow(run, schema)


def whitener(mean: np.ndarray, cov: np.ndarray, n: int, columns: Sequence[str], floor: float = 1e-9) -> Whitener:
    """From a covariance; eigenvalues below ``floor`` times the largest are raised to it."""
    if n <= len(columns):
        raise ValueError("more rows than columns are needed")
    values, vectors = np.linalg.eigh(cov)
    least = floor * values.max()
    return Whitener(tuple(columns), mean, vectors / np.sqrt(np.maximum(values, least)), int((values < least).sum()))


def empirical_whitener(train: DataFrame, columns: Sequence[str]) -> Whitener:
    """Whitening by the sample covariance of all training rows."""
    return whitener(*covariance(train, columns), columns)


def robust_whitener(train: DataFrame, columns: Sequence[str], sample_rows: int = 30_000, support: float = 1.0, seed: int = 42, key: str = "row_id") -> Whitener:
    """Whitening by the reweighted minimum covariance determinant on at most ``sample_rows`` rows.

    The raw estimate uses the share ``support`` of least distant rows (all of them
    at 1), is made consistent at the normal distribution, and is estimated again
    from the rows within the 97.5 % quantile.
    """
    p = len(columns)
    sample = hash_rank(train.select(key, *columns).dropna(), [], seed, key, "__rank").where(F.col("__rank") <= sample_rows)
    x = sample.orderBy("__rank").select(*columns).toPandas().to_numpy(dtype=float)  # bounded by sample_rows
    if len(x) <= p:
        raise ValueError("more rows than columns are needed")

    def fit(rows):
        return rows.mean(0), np.cov(rows.T, ddof=0).reshape(p, p)

    def distance2(mean, cov):
        d = x - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov), d)

    mean, cov = fit(x)
    for _ in range(30 if support < 1 else 0):
        kept = np.argsort(distance2(mean, cov), kind="stable")[: max(p + 1, int(support * len(x)))]
        new = fit(x[kept])
        if np.allclose(new[0], mean) and np.allclose(new[1], cov):
            break
        mean, cov = new
    cov = cov * (np.median(distance2(mean, cov)) / chi2_quantile(0.5, p))
    inside = distance2(mean, cov) <= chi2_quantile(0.975, p)
    mean, cov = fit(x[inside])
    cov = cov * (np.median(distance2(mean, cov)[inside]) / chi2_quantile(0.5, p))
    return whitener(mean, cov, len(x), columns)
