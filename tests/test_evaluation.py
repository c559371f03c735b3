import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzfold.operators import evaluation as e
from quartzfold.operators import scores, statistics


def test_average_precision_and_auc(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0), (None, 1)], "s double, y int")
    assert e.average_precision(df, "s", "y").first()["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 0.5)
    assert e.roc_auc(df, "s", "y").first()["roc_auc"] == pytest.approx((3 + 1.5) / 6)
    none = df.where("y = 0")
    assert e.average_precision(none, "s", "y").first()["average_precision"] == 0
    assert e.roc_auc(none, "s", "y").first()["roc_auc"] is None


def test_weighted_threshold_is_that_of_the_expanded_sample(spark):
    rng = np.random.default_rng(0)
    s, y = np.r_[rng.normal(size=300), rng.normal(3, 1, 20)], np.r_[np.zeros(300), np.ones(20)]
    df = spark.createDataFrame([(float(a), 3.0 if b == 0 else 1.0) for a, b in zip(s, y)], "s double, w double")
    wide = np.sort(np.r_[np.repeat(s[:300], 3), s[300:]])
    want = np.quantile(wide, 0.95, method="inverted_cdf")
    assert e.weighted_threshold(df, "s", "w", 0.05).first()["threshold"] == pytest.approx(want)


def test_confusion_and_summary(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "p int, y int")
    r = e.confusion(df, "p", "y").first()
    assert (r["TP"], r["FP"], r["FN"], r["TN"], r["precision"], r["recall"], r["f1"]) == (0, 0, 1, 1, 0, 0, 0)
    m = {x["metric"]: x for x in e.fold_summary(spark.createDataFrame([(0.6, 7.0), (0.7, 8.0), (0.8, 9.0)], "auprc double, TP double"), ["auprc", "TP"]).collect()}
    assert m["auprc"]["mean"] == pytest.approx(0.7) and m["auprc"]["deviation"] == pytest.approx(0.1) and m["TP"]["deviation"] == 1


def test_percentile_rank(spark):
    ref = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0)], "v double")
    val = spark.createDataFrame([(v,) for v in (0.5, 2.0, 3.5, 10.0)], "v double")
    got = {r["v"]: r["percentile_rank"] for r in scores.percentile_rank(ref, val, "v").collect()}
    assert got == {0.5: 0.0, 2.0: 0.5, 3.5: 0.75, 10.0: 1.0}


def test_ks_and_spearman(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 2.5), (1, 4.0), (1, None)], "g int, v double")
    assert statistics.ks_two_sample(df, ["v"], "g").first()["d"] == pytest.approx(2 / 3)
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, 9.0), (3.0, 9.0), (None, 1.0)], "a double, b double")
    r = statistics.spearman(df, "a", "b").first()
    assert r["n"] == 4 and r["rho"] == pytest.approx(1)


def test_density_regions():
    d = np.arange(1, 101) / 100
    assert statistics.density_regions(d, np.array([1.0, 0.6, 0.05]), [0.5, 0.9]).tolist() == [0, 0, 2]
