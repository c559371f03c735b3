import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzfold.operators import density, scorers
from quartzfold.operators.experiment import RunConfig
from quartzfold.plans import pipeline


def folds(spark):
    rng = np.random.default_rng(0)
    rows = []
    for fold in (1, 2):
        for i in range(120):
            odd = i % 15 == 0
            x = rng.normal(12 if odd else (0 if i % 2 else 5), 3 if odd else 0.3, 2)
            rows.append((fold, i, [float(v) for v in x], int(odd), "train" if i < 80 else "val"))
    return spark.createDataFrame(rows, "fold int, id bigint, vector array<double>, Class int, part string")


CONFIG = RunConfig(distance="euclidean", alert_rate=0.1, extra_rates=(0.05, 0.1, 0.2), extra_metrics=("dbcv",), min_cluster_size=(5, 10), min_samples=(4,))


def test_inner_cycle_is_kept_resumed_and_guarded(spark, tmp_path):
    f, folder = folds(spark), str(tmp_path / "run")
    h = pipeline.inner_cycle(f, CONFIG, folder=folder, only_folds=[1])
    assert h.columns == [c for c, _ in pipeline.history_columns(CONFIG)]
    assert h.columns[:8] == ["fold", "combo_id", "min_cluster_size", "min_samples", "disco_score", "dbcv_score", "n_clusters", "n_noise_points"]
    assert "f1_at_0.2" in h.columns and "TP_at_0.05" in h.columns and not any(c.endswith("at_0.1") for c in h.columns)
    first = {(r["fold"], r["combo_id"]): r["train_time_min"] for r in h.collect()}
    assert set(first) == {(1, 0), (1, 1)}
    again = pipeline.inner_cycle(f, CONFIG, folder=folder, resume=True)
    rows = again.collect()
    assert {(r["fold"], r["combo_id"]) for r in rows} == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert all(r["train_time_min"] == first[k] for r in rows if (k := (r["fold"], r["combo_id"])) in first)
    assert all(r["n_clusters"] >= 2 and r["disco_score"] > 0.3 and r["dbcv_score"] > 0 and min(r[c] for c in h.columns if c.startswith("auprc")) > 0.5 for r in rows)
    with pytest.raises(ValueError):
        pipeline.inner_cycle(f, replace(CONFIG, alert_rate=0.3), folder=folder, resume=True)
    best, by_fold = pipeline.select_best(again, CONFIG)
    assert set(by_fold) == {1, 2}
    pipeline.save_inner(again, best, by_fold, folder)
    assert set(json.loads((tmp_path / "run" / "best_parameters.json").read_text())) == {"1", "2"}
    report = pipeline.with_summary(pipeline.outer_cycle(f, pipeline.best_configuration(by_fold, CONFIG), CONFIG))
    lines = open(pipeline.save_report(report, folder)).read().split("\n")
    assert lines[0].startswith("fold,min_cluster_size,min_samples,precision,recall,f1,auprc,auprc_glosh") and [r.split(",")[0] for r in lines[1:5]] == ["1", "2", "mean", "deviation"]


def transactions(spark, n=400):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        odd = i % 20 == 0
        v = rng.normal(6 if odd else 0, 1, 28)
        rows.append((i, float(i * 100), *map(float, v), float(rng.lognormal(3)), int(odd)))
    rows += [(n + i, *rows[i + 1][1:]) for i in range(5)]
    return spark.createDataFrame(rows, "row_id bigint, Time double, " + ", ".join(f"V{i} double" for i in range(1, 29)) + ", Amount double, Class int")


@pytest.mark.parametrize("distance", ["euclidean", "mahalanobis", "mahalanobis_mcd"])
def test_preparation_by_distance(spark, distance):
    rows = transactions(spark).withColumns({"fold": F.lit(1), "part": F.when(F.col("row_id") % 4 == 0, "test").otherwise("train")})
    x = pipeline.prepare(rows, RunConfig(distance=distance)).toPandas()
    train = np.array(x[x.part == "train"].vector.tolist())
    assert train.shape[1] == 29 and len(np.unique(train, axis=0)) == len(train) < len(rows.where("part = 'train'").collect())
    if distance != "mahalanobis_mcd":
        assert abs(train.mean(0)).max() < 1e-9
    if distance == "mahalanobis":
        assert np.cov(train.T) == pytest.approx(np.eye(29), abs=1e-8)


def test_run_from_the_command_line(spark, tmp_path, monkeypatch):
    transactions(spark).write.parquet(str(tmp_path / "data" / "creditcard.parquet"))
    argv = ["--base", "undersampled", "--distance", "euclidean", "--data", str(tmp_path / "data"), "--results", str(tmp_path / "results"), "--min-samples", "5", "--min-cluster-size", "10"]
    path = pipeline.main(argv, spark)
    assert path.endswith("hdbscan_euclidean_undersampled/outer_report.csv")
    lines = [r.split(",") for r in open(path).read().strip().split("\n")]
    assert len(lines) == 8 and float(lines[6][lines[0].index("auprc_center_distance")]) > 0.9
    with pytest.raises(SystemExit):
        pipeline.arguments(["--base", "half", "--distance", "euclidean"])


def test_undersampled_folds(spark):
    config = RunConfig(base="undersampled", legitimate=100)
    outer, inner, weights = pipeline.nested_folds(transactions(spark), config)
    n = {(r["fold"], r["part"], r["Class"]): r["count"] for r in outer.groupBy("fold", "part", "Class").count().collect()}
    assert all(n[k, "train", 0] == 100 and weights[k] == pytest.approx((385 - n[k, "test", 0]) / 100) for k in range(1, 6))
    kept = outer.where("part = 'train'").select("fold", "row_id")
    assert inner.where("part = 'train'").select("fold", "row_id").exceptAll(kept).count() == 0
    drawn = {k: {r[0] for r in kept.where(f"fold = {k}").select("row_id").collect()} for k in (1, 2)}
    assert drawn[1] != drawn[2]


def test_weighted_threshold_of_a_fold():
    s, y = np.arange(100.0), (np.arange(100) >= 90).astype(int)
    assert scorers.threshold(s, 0.1) == pytest.approx(89.1)
    assert scorers.threshold(s, 0.1, y, 3.0) == pytest.approx(next(v for v in s if (3.0 * min(v + 1, 90) + max(v - 89, 0)) >= 0.9 * 280))
    with pytest.raises(ValueError):
        scorers.threshold(s, 0.1, None, 2.0)


def test_positions_of_a_stratified_sample():
    labels = np.repeat([0, 1, -1], [600, 300, 100])
    at = scorers.stratified_positions(labels, 101, 1)
    assert len(at) == 101 == len(set(at)) and np.bincount(labels[at] + 1).tolist() == [10, 61, 30]
    assert len(scorers.stratified_positions(np.r_[labels, 7], 50, 1)) == 50
    assert scorers.stratified_positions(labels, 5000, 1).tolist() == list(range(1000))


def test_supervised_search(spark, tmp_path):
    f = folds(spark).withColumns({"a": F.col("vector")[0], "b": F.col("vector")[1]})
    out = pipeline.supervised_search(f, [{"n_estimators": 3, "max_depth": 3}], "forest", ["a", "b"], {2: 2.0}, done={(1, 0)})
    r = out.collect()
    assert len(r) == 1 and r[0]["fold"] == 2 and r[0]["average_precision"] > 0.6
    assert pipeline.supervised_search(f, [{}], "boost", ["a", "b"], done={(1, 0), (2, 0)}) is None
    values = {"n_estimators": [2, 3], "max_depth": [2]}
    history, means, best = pipeline.manual_grid_search(f, values, "forest", ["a", "b"], str(tmp_path / "rf"))
    assert history.count() == 4 and means.count() == 2 and best["max_depth"] == 2
    history, _, _ = pipeline.manual_grid_search(f, values, "forest", ["a", "b"], str(tmp_path / "rf"), resume=True)
    assert history.count() == 4
    with pytest.raises(ValueError):
        pipeline.manual_grid_search(f, {"n_estimators": [9]}, "forest", ["a", "b"], str(tmp_path / "rf"), resume=True)


def test_approximate_predict():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.3, (50, 2)), rng.normal(5, 0.3, (50, 2)), [[40.0, 40.0], [-40.0, 9.0]]])
    label, _, rows = density.hdbscan(x, 10, 5)
    got, p = density.approximate_predict(x, label, rows, density.core_distances(x, 5), np.array([[0.0, 0.1], [5.1, 5.0], [-300.0, 300.0]]), 5)
    assert got[0] == label[0] and got[1] == label[60] and got[2] == -1 and p[0] > 0.5 and p[2] == 0
