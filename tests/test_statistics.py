import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzfold.functions.ordering import running
from quartzfold.operators import reports, statistics
from quartzfold.session import materialize, scratch


def test_running_sums_of_groups_of_very_different_range(spark):
    rows = [(g, float(i) * scale, i % 7) for g, scale in enumerate((1e-6, 1.0, 1e9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, v double, n int").repartition(5)
    for down in (False, True):
        got = {(r["g"], r["v"]): r["cum_n"] for r in running(df, ["g"], "v", ["n"], down).collect()}
        for g, v, _ in rows[::37]:
            assert got[g, v] == sum(n for h, w, n in rows if h == g and (w >= v if down else w <= v))


def test_cuts_of_running_sums_are_taken_once(spark):
    # On a cluster partitions arrive in another order each time, so cuts taken again are others and the lanes' offsets do not fit.
    df = spark.createDataFrame([(i % 2, float(i), 1) for i in range(600)], "g int, v double, n int").repartition(5)
    sums = running(df, ["g"], "v", ["n"])
    assert "percentile_approx" not in sums._jdf.queryExecution().optimizedPlan().toString()
    assert {r["v"]: r["cum_n"] for r in sums.collect()} == {float(i): i // 2 + 1 for i in range(600)}


def test_tail_of_t_by_integration():
    for t, k in ((0.5, 1), (2.0, 10), (-1.3, 4), (4.0, 200)):
        x = np.linspace(abs(t), abs(t) + 4000, 4_000_001) if k == 1 else np.linspace(abs(t), abs(t) + 300, 3_000_001)
        y = math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi) * (1 + x * x / k) ** (-(k + 1) / 2)
        rest = 2 / (math.pi * x[-1]) if k == 1 else 0.0
        assert statistics.t_tail(t, k) == pytest.approx(2 * np.trapezoid(y, x) + rest, rel=1e-4)
    assert statistics.t_tail(0.0, 5) == pytest.approx(1)
    assert statistics.spearman_p(1.0, 9) == 0 and math.isnan(statistics.spearman_p(0.3, 2)) and 0 < statistics.spearman_p(-0.4, 30) < 0.05


def test_discriminative_power_finds_the_direction(spark):
    rows = [(i % 2, float(i % 2), -float(i % 2), None if i == 3 else 5.0) for i in range(40)]
    df = spark.createDataFrame(rows, "y int, up double, down double, same double")
    got = {r["feature"]: (r["average_precision"], r["direction"]) for r in statistics.discriminative_power(df, ["up", "down", "same"], "y").collect()}
    assert got["up"] == (1.0, 1) and got["down"] == (1.0, -1) and got["same"] == (pytest.approx(19 / 39, abs=1e-9), 1)


def test_plane_density_and_regions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal([1.0, -2.0], [1.0, 0.5], (600, 2))
    df = spark.createDataFrame([(0, *map(float, r)) for r in x] + [(1, None, 0.0)], "c int, x double, y double")
    points = [(a / 2, b / 2) for a in range(-6, 11) for b in range(-12, 5)]
    k = statistics.density_levels(materialize(statistics.kde_plane(df, "x", "y", "c", points), "k"), "c")
    rows = k.collect()
    assert sum(r["density"] for r in rows) / 4 == pytest.approx(1, abs=0.02)
    best = max(rows, key=lambda r: r["density"])
    assert abs(best["px"] - 1) <= 0.5 and best["py"] == -2.0
    share = {r["region"]: r["share"] for r in statistics.region_share(df.where("x is not null").select(F.col("x").alias("px"), F.col("y").alias("py")), k, "c", 0.5, [0.5, 0.9]).collect()}
    assert 0.3 < share[0.5] < 0.7 < share[0.9] <= 1


def test_reports(spark):
    df = spark.createDataFrame([("1", 0.5), ("2", 0.25), ("mean", 0.375)], "fold string, v double")
    assert [r["fold"] for r in reports.report_folds(df, 2).orderBy("fold").collect()] == [1, 2]
    with pytest.raises(ValueError):
        reports.report_folds(df, 5)
    assert df.select(reports.decimal_text("v").alias("t")).first()["t"] == "0,500"
    reports.check_rates(["f1_at_0.0017"], [0.0017], ["f1"])
    with pytest.raises(ValueError):
        reports.check_rates(["f1_at_0.0017"], [0.0017, 0.5], ["f1"])
    other = df.select("fold", F.lit(1).alias("w"))
    assert reports.merge_stages(df, other, ["fold"]).count() == 3
    for bad in (other.where("fold <> '1'"), other.unionByName(other)):
        with pytest.raises(ValueError):
            reports.merge_stages(df, bad, ["fold"])


def test_scratch_deletes_its_tables(spark):
    with scratch(spark):
        t = materialize(spark.range(5), "kept")
        files = t.inputFiles()
        assert t.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(files[0]).count()
