from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzfold.llm.packing import fill, pack


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.lists(st.integers(0, 60), max_size=20))
def test_sweep_fills_gaps_until_nothing_fits(sizes, gaps):
    s, g = np.sort(np.array(sizes, np.int64)), np.sort(np.array(gaps, np.int64))
    at = fill(s, g)
    room = g.copy()
    np.subtract.at(room, at[at >= 0], s[at >= 0])
    assert (room >= 0).all()
    rest = s[at < 0]
    assert not len(rest) or not len(room) or room.max() < rest.min()
    # By the definition: gap by gap the largest document left that fits.
    left, want = sorted(sizes), []
    for r in sorted(gaps):
        took = []
        while any(v <= r for v in left):
            v = max(v for v in left if v <= r)
            left.remove(v)
            took.append(v)
            r -= v
        want.append(took)
    assert [sorted(s[at == i].tolist(), reverse=True) for i in range(len(g))] == want


@pytest.mark.parametrize("task_rows", [50_000, 150])
def test_pack(spark, task_rows):
    rng = np.random.default_rng(0)
    sizes = {i: int(v) for i, v in enumerate(rng.lognormal(4, 1.5, 3000))} | {5000: 0, 5001: None, 5002: 1024, 5003: 2048, 5004: 1025}
    rows = pack(spark.createDataFrame(list(sizes.items()), "id bigint, tokens bigint").repartition(5).selectExpr("*", "1 as gap", "2 as piece", "3 as container_id"), 1024, task_rows).collect()
    held, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        pieces[r["id"]].append((r["token_from"], r["tokens"]))
        if r["container_id"] is not None:
            held[r["container_id"]] += r["tokens"]
    assert set(pieces) == set(sizes)
    for i, n in sizes.items():
        p = sorted(pieces[i])
        assert sum(t for _, t in p) == (n or 0) and all(a + t == b for (a, t), (b, _) in zip(p, p[1:]))
        assert (len(p) > 1) == ((n or 0) > 1024)
    assert max(held.values()) <= 1024 and sum(held.values()) / (1024 * len(held)) > 0.97
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "id bigint, tokens bigint"), 0)
    assert pack(spark.createDataFrame([], "id bigint, tokens bigint"), 1024).count() == 0
