import numpy as np
import pytest

from quartzfold.llm import cube

IDENTITY = ["x", "y"]


def run(spark, rows, requests):
    r = spark.createDataFrame(rows, "batch_id bigint, category int, row_id bigint, x double, y double").repartition(5).selectExpr("*", "1.0 as p", "2 as turn")
    q = spark.createDataFrame(requests, "request_id bigint, batch_id bigint, sample_size int, category int, target_share double, min_rows int")
    sample, report = cube.draw(r, q, IDENTITY)
    return sample.collect(), {(x["request_id"], x["category"]): x for x in report.collect()}


def test_shares_are_met_exactly_and_shortage_is_reported(spark):
    rows = [(1, 0, i, float(i), None) for i in range(1000)] + [(1, 1, 5000 + i, float(i), 0.0) for i in range(7)] + [(1, 1, 6000, 3.0, 0.0)] + [(1, None, 7000, 1.0, 1.0), (None, 0, 7001, 1.0, 1.0)]
    requests = [(1, 1, 100, 0, 0.9, 5), (1, 1, 100, 1, 0.1, 0), (2, 1, 40, 0, 1.0, 5), (2, 1, 40, 1, 0.0, 2), (3, 9, 10, 0, 1.0, 0), (4, 1, 10, 0, None, None)]
    sample, report = run(spark, rows, requests)
    r = {k: (v["need"], v["supply"], v["drawn"]) for k, v in report.items()}
    assert r == {(1, 0): (90, 1000, 90), (1, 1): (10, 7, 7), (2, 0): (40, 1000, 40), (2, 1): (2, 7, 2), (3, 0): (10, 0, 0), (4, 0): (0, 1000, 0)}
    assert len({(s["request_id"], s["row_id"]) for s in sample}) == len(sample) == 139
    assert report[(3, 0)]["share"] is None


def test_every_record_has_the_same_chance(spark):
    rows = [(b, 0, 100 * b + i, float(i), 0.0) for b in range(60) for i in range(10)]
    sample, _ = run(spark, rows, [(b, b, 5, 0, 1.0, 0) for b in range(60)])
    times = [0] * 10
    for s in sample:
        times[s["row_id"] % 100] += 1
    assert sum(times) == 300 and min(times) > 12 and max(times) < 48


def test_empty(spark):
    sample, report = run(spark, [], [])
    assert sample == [] and report == {}


@pytest.mark.parametrize("full,mass,n", [(10**9, 1, 50), (7, 3, 1000), (10**12, 10**12 - 1, 333), (5, 5, 4)])
def test_flight_keeps_every_mass_and_leaves_one(full, mass, n):
    m, f = np.full(n, mass), np.full(n, full)
    left = cube.fly(np.zeros(n, int), m, f, np.random.default_rng(0).random(n))
    assert m.sum() == n * mass and len(left) <= 1 and (m >= 0).all() and (m <= full).all()
    assert (m == full).sum() == n * mass // full


def test_flight_is_fair():
    rng, times = np.random.default_rng(1), np.zeros(9)
    group, mass = np.repeat(np.arange(4000), 9), np.full(36000, 2)
    cube.fly(group, mass, np.full(36000, 9), rng.random(36000))
    times = (mass == 9).reshape(4000, 9).sum(0)
    assert times.sum() == 8000 and abs(times / 8000 - 1 / 9).max() < 0.012
