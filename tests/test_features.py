import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzfold.operators import features as f
from quartzfold.operators import neighbors
from quartzfold.sources.tables import V_COLUMNS


def test_derive(spark):
    rows = [(i, t, a, *[0.0] * 28) for i, (t, a) in enumerate([(90000.0, 99.0), (82800.0, 0.0), (0.0, 0.0), (None, None)])]
    df = spark.createDataFrame(rows, "row_id int, Time double, Amount double, " + ", ".join(f"{c} double" for c in V_COLUMNS))
    r = {x["row_id"]: x for x in f.derive(df, keep=["row_id"]).collect()}
    assert r[0]["log_amount"] == pytest.approx(math.log(100)) and r[0]["hour_sin"] == pytest.approx(math.sin(2 * math.pi / 24))
    assert math.hypot(r[1]["hour_sin"] - r[2]["hour_sin"], r[1]["hour_cos"] - r[2]["hour_cos"]) < 0.3
    assert r[3]["log_amount"] is None
    assert f.derive(df, excluded=["hour_sin", "hour_cos"]).columns == [*V_COLUMNS, "log_amount"]
    with pytest.raises(ValueError):
        f.derive(df, excluded=["hour"])


def test_scalers_use_training_statistics_only(spark):
    train = spark.createDataFrame([(0.0, 5.0), (1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    s = f.standard_scaler(train, ["a", "b"])
    x = np.array([0, 1, 2, 4.0])
    assert s.location[0] == 1.75 and s.scale == pytest.approx((x.std(), 1.0))
    r = f.robust_scaler(train, ["a"])
    assert r.location == (1.5,) and r.scale == (1.75,)
    assert s.apply(train.select("b", "a")).columns == ["a", "b"]


def correlated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3))
    x[:8] += rng.normal(0, 6, (8, 3))
    return x


def test_whitening_is_mahalanobis_and_robust_ranks_outliers_first(spark):
    x = correlated()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0)], "row_id bigint, a double, b double, c double").repartition(5)
    w = f.empirical_whitener(df, ["a", "b", "c"])
    got = {r["row_id"]: r["distance"] for r in w.apply(df).collect()}
    d = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x.T)), d))
    assert got[999] is None and [got[i] for i in range(400)] == pytest.approx(list(want))
    robust = {r["row_id"]: r["distance"] for r in f.robust_whitener(df, ["a", "b", "c"]).apply(df.where("row_id < 999")).collect()}
    strongest = sorted(range(400), key=lambda i: -robust[i])[:6]
    assert sum(i < 8 for i in strongest) >= 5


def test_singular_and_short(spark):
    x = correlated()
    df = spark.createDataFrame([(*map(float, r), float(r[0] + r[1])) for r in x], "a double, b double, c double, e double")
    assert f.empirical_whitener(df, ["a", "b", "c", "e"]).floored == 1
    with pytest.raises(ValueError):
        f.empirical_whitener(df.limit(3), ["a", "b", "c"])


def test_chi2_quantile():
    assert f.chi2_quantile(0.975, 2) == pytest.approx(-2 * math.log(0.025))
    assert f.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)


def test_knn_blocks_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 30)
    x = np.random.default_rng(0).integers(0, 4, size=(100, 2)).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(500, None)], "id bigint, vector array<double>").repartition(3)
    got = {(r["query"], r["rank"]): r["id"] for r in neighbors.knn(df, df, 3).collect()}
    for q in range(100):
        d = ((x - x[q]) ** 2).sum(1)
        want = [int(i) for i in np.lexsort((np.arange(100), d)) if i != q][:3]
        assert [got[(q, k)] for k in (1, 2, 3)] == want
    self = neighbors.knn(df, df, 1, include_self=True)
    assert self.agg(F.max("distance")).first()[0] == 0
    assert neighbors.nearest_core(df.where("false").withColumn("label", F.lit(1)), df, 1.0).where("label = -1 and distance = 0").count() == 101
