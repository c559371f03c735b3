import numpy as np

from quartzfold.llm import hashing

F3 = ["a", "b", "c", "d"]


def frame(spark, x, extra=()):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double")


def brute(x, ids, q, k=5):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [int(ids[i]) for i in np.lexsort((ids, d)) if i != q][:k]


def test_recall_nulls_and_other_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4)).round(3)
    df = frame(spark, x, [(9000, None, 1.0, 1.0, 1.0)]).selectExpr("*", "a as vector", "id as query", "1 as lane")
    got = hashing.similar(df, df.where("id % 20 = 0"), F3).collect()
    by = {}
    for r in got:
        by.setdefault(r["query"], []).append((r["place"], r["id"]))
    assert set(by) == set(range(0, 4000, 20))
    hit = sum(len({i for _, i in by[q]} & set(brute(x, np.arange(4000), q))) for q in by)
    assert hit / (5 * len(by)) >= 0.9
    assert all(q not in {i for _, i in v} and len(v) == 5 for q, v in by.items())


def test_copies_and_few_rows(spark):
    x = np.vstack([np.zeros((600, 4)), np.ones((3, 4))])
    df = frame(spark, x)
    got = {}
    for r in hashing.similar(df, df.where("id in (0, 7, 601)"), F3).collect():
        got.setdefault(r["query"], []).append(r["id"])
    assert sorted(got[0]) == [1, 2, 3, 4, 5] and sorted(got[7]) == [0, 1, 2, 3, 4]
    assert set(got[601]) == {600, 602, 0, 1, 2}
    three = frame(spark, x[:3])
    assert hashing.similar(three, three, F3).count() == 6


def test_empty(spark):
    df = frame(spark, np.zeros((0, 4)))
    assert hashing.similar(df, df, F3).count() == 0


def test_rings_give_what_comparing_all_gives(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(700, 6)), rng.normal(3, 0.01, size=(900, 6)), np.full((60, 6), 3.0)]).astype(np.float32)
    ids, q = np.arange(len(x)), x[::7]
    want = hashing.best(*hashing.nearest(ids[::7], q, ids, x, 5), 5)
    monkeypatch.setattr(hashing, "LARGE_BUCKET", 200)
    got = hashing.best(*hashing.nearest(ids[::7], q, ids, x, 5), 5)
    assert all((a == b).all() for a, b in zip(want, got))
    limit = np.sort(want[2].reshape(-1, 5), axis=1)[:, 4]
    got = hashing.best(*hashing.nearest(ids[::7], q, ids, x, 5, limit), 5)
    assert all((a == b).all() for a, b in zip(want, got))


def test_long_codes_and_more_substrings(spark):
    assert hashing.bits_for(10**6, 31) == 11 and 18 <= hashing.bits_for(10**9, 31) <= 24
    x = np.random.default_rng(3).normal(size=(3000, 4)).round(3)
    df = frame(spark, x)
    asked = df.where("id % 50 = 0")
    true = {(r["query"], r["id"]) for r in hashing.exact(df, asked, F3, 5).collect()}
    assert true == {(q, i) for q in range(0, 3000, 50) for i in brute(x, np.arange(3000), q)}
    found = {(r["query"], r["id"]) for r in hashing.similar(df, asked, F3, substrings=3).collect()}
    assert len(true & found) / len(true) >= 0.9
