import math

import numpy as np
import pytest

from quartzfold.llm import quantiles as q


def summary(values, budget):
    v = np.sort(np.asarray(values, float))
    (_, n, small, v, lo, hi) = q._condense(np.zeros(len(v), int), v, np.ones(len(v), int), budget)[0]
    return (*(q.expand(v, lo, hi) if small else (v, lo, hi)), n)


def off_by(values, answer, rank):
    s = np.sort(values)
    lo, hi = np.searchsorted(s, answer, "left") + 1, np.searchsorted(s, answer, "right")
    return max(lo - rank, rank - hi, 0)


@pytest.mark.parametrize("seed", range(4))
def test_merged_error_is_within_what_the_summary_says(seed):
    rng = np.random.default_rng(seed)
    parts = [np.r_[rng.normal(size=rng.integers(1, 3000)), np.full(rng.integers(0, 900), 0.5)] for _ in range(9)]
    merged = summary(parts[0], 50)
    for p in parts[1:]:
        v, lo, hi, n = q.merge([merged, summary(p, 50)])
        merged = (*q.compress(v, lo, hi, n, 50), n)
    all_ = np.concatenate(parts)
    assert merged[3] == len(all_) and len(merged[0]) <= 50
    for p in (0.01, 0.25, 0.5, 0.77, 0.99):
        rank = max(1, math.ceil(p * len(all_)))
        x, stated = q.answer(*merged, rank)
        assert off_by(all_, x, rank) <= stated


def test_groups_nulls_nan_ties_and_infinities(spark):
    rows = [("a", float(i % 7)) for i in range(1000)] + [("a", float("nan")), ("a", None), (None, 3.0), ("i", float("inf")), ("i", -float("inf")), ("n", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumnRenamed("v", "value")
    s = q.summarize(df, ["g"], "value", 0.01)
    got = {r["g"]: r for r in q.percentiles(s, "g string", {"p50": 0.5, "p99": 0.99}).collect()}
    assert set(got) == {"a", None, "i"}
    assert got["a"]["n"] == 1000 and got["a"]["p50"] == 3.0 and got["a"]["rank_error"] == 0
    assert got["i"]["p50"] == -math.inf and got["i"]["p99"] == math.inf
    assert got[None]["p50"] == 3.0


def test_days_join_into_one_within_the_bound(spark):
    rng = np.random.default_rng(1)
    rows = [("x", int(i % 5), float(v)) for i, v in enumerate(rng.lognormal(size=20000))]
    df = spark.createDataFrame(rows, "g string, day int, value double").repartition(7)
    s = q.summarize(df, ["g", "day"], "value", 0.01)
    one = q.merge_summaries(q.regroup(s, "g string, day int", ["g"]), levels=2, epsilon=0.01)
    r = q.percentiles(one, "g string", {"p90": 0.9}).first()
    v = np.array([x[2] for x in rows])
    assert r["n"] == 20000 and off_by(v, r["p90"], 18000) <= r["rank_error"] <= 0.02 * 20000


def test_empty(spark):
    df = spark.createDataFrame([], "g string, value double")
    assert q.percentiles(q.summarize(df, ["g"], "value"), "g string", {"p": 0.5}).count() == 0
