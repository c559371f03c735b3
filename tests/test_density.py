import numpy as np
import pytest

from quartzfold.operators import density, scores, validity


def cloud(seed, n=40, p=3, copies=0):
    x = np.random.default_rng(seed).normal(size=(n, p))
    return np.vstack([x, x[:copies]])


def reach_matrix(x, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, m - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    np.fill_diagonal(w, 0)
    return w, core


def closure(w):
    """Smallest possible largest step between any two points."""
    w = w.copy()
    for k in range(len(w)):
        w = np.minimum(w, np.maximum(w[:, k : k + 1], w[k : k + 1]))
    return w


@pytest.mark.parametrize("m", [1, 3, 40])
def test_core_distance_by_sorting(m):
    x = cloud(3, copies=5)
    assert density.core_distances(x, m) == pytest.approx(reach_matrix(x, m)[1], abs=1e-12)


def test_core_distance_needs_a_possible_number():
    for m in (0, 41):
        with pytest.raises(ValueError):
            density.core_distances(cloud(0), m)


def test_core_distance_of_copies_is_zero():
    assert (density.core_distances(np.tile([[4.0, -2.5]], (9, 1)), 3) == 0).all()


def by_definition(x, labels, m):
    """DISCO of every point from the closure matrix."""
    w, core = reach_matrix(x, m)
    dc, names = closure(w), sorted(set(labels.tolist()) - {-1})
    rel = lambda a, b: 0.0 if max(a, b) == 0 else (a - b) / max(a, b)
    out = []
    for i, l in enumerate(labels):
        if l >= 0:
            own = [j for j in np.flatnonzero(labels == l) if j != i]
            if not own:
                out.append(0.0)
                continue
            if len(names) > 1:
                other = min(dc[i, labels == c].mean() for c in names if c != l)
            else:
                other = dc[i, labels == -1].min()
            out.append(rel(other, dc[i, own].mean()))
        else:
            wide = {c: core[labels == c].max() for c in names}
            out.append(min(min(rel(core[i], wide[c]), rel(dc[i, labels == c].min(), wide[c])) for c in names))
    return out


@pytest.mark.parametrize("names", [[0, 1, 2], [0, 1, -1], [5, -1]])
@pytest.mark.parametrize("seed", range(3))
def test_disco_equals_its_definition(names, seed):
    x = cloud(seed, copies=4)
    labels = np.random.default_rng(seed + 50).choice(names, len(x))
    assert validity.disco_samples(x, labels, 4) == pytest.approx(by_definition(x, labels, 4), abs=1e-9)


def test_disco_without_a_choice():
    x = cloud(9)
    assert (validity.disco_samples(x, np.full(40, -1), 3) == -1).all()
    assert (validity.disco_samples(x, np.full(40, 6), 3) == 0).all()
    assert (validity.disco_samples(np.zeros((6, 2)), np.arange(6) % 2, 3) == 0).all()
    with pytest.raises(ValueError):
        validity.disco_samples(x, np.zeros(39, int), 3)


def test_tree_equals_minimax_closure():
    x = cloud(0, 60, copies=3)
    tree, core = density.density_tree(x, 4)
    w = closure(reach_matrix(x, 4)[0])
    total, least = tree.to_groups(np.zeros(len(x), int), 1)
    assert total[:, 0] == pytest.approx(w.sum(1))
    np.fill_diagonal(w, np.inf)
    assert least[:, 0] == pytest.approx(w.min(1))


def blobs():
    rng = np.random.default_rng(1)
    return np.vstack([rng.normal(0, 0.2, (60, 2)), rng.normal(5, 0.2, (60, 2)), [[2.5, 30.0], [-26.0, 3.0]]])


def test_hdbscan_and_dbscan_find_two_blobs():
    x = blobs()
    label, member, rows = density.hdbscan(x, 10, 5)
    assert len(set(label[:60])) == len(set(label[60:120])) == 1 and label[0] != label[70] and set(label[120:]) == {-1}
    assert (member[120:] == 0).all() and 0 < member[:120].max() <= 1
    db, core = density.dbscan(x, 1.0, 5)
    assert set(db[:60]) == {0} and set(db[60:120]) == {60} and set(db[120:]) == {-1}
    p, c, l, _ = (np.array(v) for v in zip(*rows))
    assert scores.glosh_train(p, c, l)[120:].min() > 0.5
    assert validity.dbcv_score(x, label) > 0.5 > validity.dbcv_score(x, np.random.default_rng(0).integers(0, 2, len(x)))
    assert validity.dbcv_score(x, np.full(len(x), -1)) == -1


def condensed(seed):
    """A condensed tree of random points, as arrays (parent, child, lambda)."""
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, s, (25, 2)) for c, s in ((0, 0.3), (4, 0.5), (9, 0.2), (9.9, 0.2))])
    _, _, rows = density.hdbscan(x, 6, 4)
    return x, tuple(np.array(v) for v in list(zip(*rows))[:3])


def below(parent, child, cluster):
    """Positions of all rows under a cluster."""
    own = np.flatnonzero(parent == cluster)
    return own.tolist() + [i for c in child[own] if c in parent for i in below(parent, child, c)]


@pytest.mark.parametrize("seed", range(3))
def test_glosh_by_walking_down(seed):
    _, (p, c, l) = condensed(seed)
    root, top = p.min(), scores.lambda_max(p, c, l)
    assert len(top) > 2
    for k in top:
        assert top[k] == pytest.approx(max(l[i] for i in below(p, c, k) if c[i] < root))
    want = [1 - l[i] / top[p[i]] for i in np.argsort(c) if c[i] < root]
    order = np.random.default_rng(0).permutation(len(p))
    assert scores.glosh_train(p[order], c[order], l[order]) == pytest.approx(want)
    with pytest.raises(ValueError):
        scores.glosh_train(p[c != 4], c[c != 4], l[c != 4])


def test_glosh_of_infinite_lambda_is_zero():
    inf = np.inf
    assert scores.glosh_value([inf, 3.0, 2.0], [inf, 0.0, 8.0]) == pytest.approx([0, 0, 0.75])


def test_glosh_over_tables_equals_the_kernels(spark):
    x, (p, c, l) = condensed(5)
    rows = [(1, *map(float, r)) for r in zip(p, c, l)]
    rows += [(2, *map(float, r)) for r in zip(*condensed(6)[1])]
    trees = spark.createDataFrame(rows, "run int, p double, c double, lam double").selectExpr("run", "cast(p as bigint) parent", "cast(c as bigint) child", "lam")
    got = {(r["run"], r["point"]): r["glosh"] for r in scores.glosh_rows(trees, ["run"]).collect()}
    want = scores.glosh_train(p, c, l)
    assert [got[1, i] for i in range(len(want))] == pytest.approx(want)
    assert {r["cluster"]: r["lambda_max"] for r in scores.lambda_max_rows(trees.where("run = 1").drop("run")).collect()} == pytest.approx(scores.lambda_max(p, c, l))
    new = np.array([[0.1, 0.2], [6.5, 6.5], [9.4, 9.4], [40.0, -3.0]])
    d = np.sqrt(((new[:, None] - x[None]) ** 2).sum(2))
    near = np.argsort(d, axis=1, kind="stable")[:, :6]
    far, core = np.take_along_axis(d, near, 1), density.core_distances(x, 4)
    want = scores.glosh_new(p, c, l, core, far, near, far[:, 2])
    n = spark.createDataFrame([(i, k + 1, int(near[i, k]), float(far[i, k])) for i in range(4) for k in range(6)], "query bigint, rank int, id bigint, distance double")
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(core)], "id bigint, core double")
    q = spark.createDataFrame([(i, float(far[i, 2])) for i in range(4)], "id bigint, core double")
    got = {r["query"]: r["glosh"] for r in scores.glosh_new_rows(trees.where("run = 1").drop("run"), n, t, q).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(want)
    assert scores.glosh_rows(trees.where("false"), ["run"]).count() == 0
