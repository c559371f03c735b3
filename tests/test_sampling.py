import warnings

import pytest
from pyspark.sql import functions as F

from quartzfold.operators import sampling as s


def frame(spark, n, ones):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") < ones).cast("int").alias("Class"))


def test_resolve_target():
    assert s.resolve_target(["a", "b"], "b") == s.resolve_target(["a", "b"], 1) == "b"
    for bad, error in (("A", ValueError), (-1, IndexError), (2, IndexError), (1.5, TypeError), (True, TypeError), (None, TypeError)):
        with pytest.raises(error):
            s.resolve_target(["a", "b"], bad)


@pytest.mark.parametrize("n,ones,k", [(1000, 20, 5), (10000, 17, 5), (103, 31, 4)])
def test_folds_are_even_and_independent_of_partitions(spark, n, ones, k):
    df = frame(spark, n, ones)
    f = s.stratified_folds(df.repartition(7), folds=k)
    sizes = [r["n"] for r in f.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    pos = [r["n"] for r in f.where("Class = 1").groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == k and max(sizes) - min(sizes) <= 1 and sum(sizes) == n
    assert max(pos) - min(pos) <= 1 and sum(pos) == ones
    again = s.stratified_folds(df.repartition(2), folds=k)
    assert f.exceptAll(again).count() == 0


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        s.stratified_folds(frame(spark, 20, 4), folds=25)
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        s.stratified_folds(frame(spark, 100, 3), folds=10)
    assert any("fewer" in str(x.message) for x in w)


def test_holdout_undersample_quota(spark):
    df = frame(spark, 1000, 20)
    h = s.holdout(df, "Class", 0.2)
    assert {(r["Class"], r["n"]) for r in h.where("is_val").groupBy("Class").agg(F.count("*").alias("n")).collect()} == {(0, 196), (1, 4)}
    u = s.undersample(df, "Class", 0.5)
    assert {(r["Class"], r["n"]) for r in u.groupBy("Class").agg(F.count("*").alias("n")).collect()} == {(0, 490), (1, 20)}
    assert s.quota_sample(df, "Class", 100).count() == 100 and s.quota_sample(df, "Class", 5000).count() == 1000
    assert s.legitimate_fraction(980, 490) == 0.5
    with pytest.raises(ValueError):
        s.legitimate_fraction(980, 981)


def test_keep_first(spark):
    df = spark.createDataFrame([(3, 1.0, None), (1, 1.0, None), (2, 1.0, 2.0)], "row_id int, a double, b double")
    assert sorted(r["row_id"] for r in s.keep_first(df, ["a", "b"]).collect()) == [1, 2]
