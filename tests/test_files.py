import pytest
from pyspark.sql import functions as F

from quartzfold.operators import experiment, features, sampling
from quartzfold.sources import files
from quartzfold.sources.tables import V_COLUMNS
from quartzfold.streaming.scoring import alerts_per_window, score_stream


def test_csv_parts_and_metadata(spark, tmp_path):
    rows = [(float(i), *[0.5] * 28, 1.0, int(i < 10)) for i in range(100)]
    df = spark.createDataFrame(rows, files.TRANSACTIONS)
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    back = files.read_transactions(spark, str(tmp_path / "csv"))
    assert back.columns == ["Time", *V_COLUMNS, "Amount", "Class"] and back.count() == 100
    folded = sampling.stratified_folds(back.withColumn("row_id", F.col("Time").cast("bigint")))
    files.write_parts(folded.withColumn("part", F.lit("train")), str(tmp_path / "parts"))
    assert files.read_part(spark, str(tmp_path / "parts"), 2, "train").count() == 20
    meta = files.fold_metadata(folded, 42)
    files.write_json(meta, str(tmp_path / "info"))
    m = {r["fold"]: r for r in files.read_metadata(spark, str(tmp_path / "info")).collect()}
    assert len(m) == 5 and m[1]["num_train_samples"] == 80 and m[1]["class_distribution_test"] == {"0": 0.9, "1": 0.1}
    (tmp_path / "info" / "fold_9_info.json").write_text('{"undersampling": {"num_legitimate_before": 181962, "num_legitimate_after": 64086}}')
    w = {r["fold"]: r["weight"] for r in files.legitimate_weight(files.read_metadata(spark, str(tmp_path / "info"))).collect()}
    assert w[1] == 1 and w[9] == pytest.approx(2.8393, abs=1e-4)


def test_fold_ids():
    assert files.fold_ids(["x/fold_2_train.csv", "fold_1_train.csv", "fold_1_val.csv"]) == [1, 2]
    for names, expected in (([], None), (["fold_1_train.csv"], 5)):
        with pytest.raises(ValueError):
            files.fold_ids(names, expected)


def test_grid_history_and_guard(spark, tmp_path):
    g = experiment.grid(spark, experiment.BOOST_GRID)
    assert g.count() == 81 and experiment.grid(spark, experiment.FOREST_GRID).count() == 162
    path = str(tmp_path / "history")
    assert experiment.read_history(spark, path) is None
    done = g.where("combo_id < 3").withColumn("fold", F.lit(1)).withColumn("auprc", F.col("combo_id") * 0.1)
    experiment.append_history(done, path)
    with pytest.raises(ValueError):
        experiment.read_history(spark, path, ["f1"])
    h = experiment.read_history(spark, path, ["auprc"])
    assert experiment.pending(g.withColumn("fold", F.lit(1)), h).count() == 78
    names = list(experiment.BOOST_GRID)
    assert experiment.matching_rows(h, g, names).count() == 3
    with pytest.raises(ValueError):
        experiment.matching_rows(h.withColumn("gamma", F.lit("7")), g, names)
    assert experiment.plain("0") == experiment.plain(0.0) == 0 and experiment.plain(float("nan")) is None and experiment.plain("sqrt") == "sqrt"
    c = experiment.RunConfig()
    experiment.guard(spark, str(tmp_path / "run"), c, resume=False)
    experiment.guard(spark, str(tmp_path / "run"), c, resume=True)
    with pytest.raises(ValueError):
        experiment.guard(spark, str(tmp_path / "run"), experiment.RunConfig(alert_rate=0.01), resume=True)
    for bad in ({"distance": "cosine"}, {"score": "x"}, {"selection": "f1"}, {"alert_rate": 1.0}, {"base": "half"}, {"excluded": ("V99",)}, {"extra_scores": ("p",)}):
        with pytest.raises(ValueError):
            experiment.RunConfig(**bad)
    assert experiment.metric_at("f1", 0.0017) == "f1_at_0.0017"


def test_streaming_score_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(float(i), f"2030-01-01 0{i % 4}:30:00") for i in range(40)], "a double, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    s = features.standard_scaler(df, ["a"])
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = alerts_per_window(score_stream(stream, s, 1.5), "at").writeStream.format("memory").queryName("alerts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = alerts_per_window(score_stream(df, s, 1.5), "at")
    assert spark.table("alerts").exceptAll(batch).count() == 0 and batch.count() == 4
