import numpy as np
import pytest

from quartzfold.llm import chunks

FIELDS = [f"f{i}" for i in range(28)]
NEAR = {"t": (600.0, 60.0), "m": (1.0, 0.05)}


def brute(rows, splits):
    at = {r[0]: r for r in rows}
    out = set()
    for s, train, a in splits:
        for s2, train2, b in splits:
            if s == s2 and train and not train2 and a in at and b in at:
                x, y = at[a], at[b]
                if None in (x[1], y[1], x[2], y[2]) or abs(x[1] - y[1]) > 60 or abs(x[2] - y[2]) > 0.05 + 1e-9:
                    continue
                n = sum((p is None) != (q is None) or (p is not None and q is not None and abs(p - q) > 0.01 + 1e-9) for p, q in zip(x[3:], y[3:]))
                if n <= 2:
                    out.add((a, b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows, splits = [], []
    for i in range(150):
        v = [round(float(x), 4) for x in rng.normal(size=28)]
        t, m = float(rng.integers(100000)), round(float(rng.lognormal(3)), 2)
        for k in range(int(rng.integers(1, 4))):
            w = [round(x + float(rng.uniform(-0.01, 0.01)), 6) if k else x for x in v]
            for j in rng.choice(28, int(rng.integers(0, 5)), False):
                w[j] = None if rng.random() < 0.3 else w[j] + 1
            rid = len(rows)
            rows.append((rid, None if rng.random() < 0.02 else t + float(rng.integers(-70, 71)) * (k > 0), m + 0.05 * (k > 0), *w))
            if rng.random() < 0.95:
                splits += [(int(rng.integers(2)), bool(rng.random() < 0.6), rid)] * int(rng.integers(1, 3))
    df = spark.createDataFrame(rows, "row_id bigint, t double, m double, " + ", ".join(f"{c} double" for c in FIELDS)).selectExpr("*", "1 as digest", "2 as split", "3 as length")
    s = spark.createDataFrame(splits + [(0, True, 99999)], "split bigint, train boolean, row_id bigint")
    got = {(r["train_id"], r["eval_id"]) for r in chunks.overlaps(df, s, FIELDS, NEAR).collect()}
    assert got == brute(rows, splits) and got


def test_empty(spark):
    df = spark.createDataFrame([], "row_id bigint, t double, m double, " + ", ".join(f"{c} double" for c in FIELDS))
    assert chunks.overlaps(df, spark.createDataFrame([], "split bigint, train boolean, row_id bigint"), FIELDS, NEAR).count() == 0
    with pytest.raises(ValueError):
        chunks.overlaps(df, df, FIELDS, NEAR, different=4)


def test_a_record_in_several_splits(spark):
    rows = [(i, 10.0, 5.0, *[0.3 * j for j in range(28)]) for i in (1, 2)]
    df = spark.createDataFrame(rows, "row_id bigint, t double, m double, " + ", ".join(f"{c} double" for c in FIELDS))
    s = spark.createDataFrame([(k, i == 1, i) for k in (1, 2, 3) for i in (1, 2)], "split bigint, train boolean, row_id bigint")
    got = sorted((r["split"], r["train_id"], r["eval_id"], r["overlap"]) for r in chunks.overlaps(df, s, FIELDS, NEAR).collect())
    assert got == [(k, 1, 2, 1.0) for k in (1, 2, 3)]
