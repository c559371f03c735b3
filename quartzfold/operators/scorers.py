"""Registries of one fold's clustering: anomaly scores and validity metrics (NumPy kernels)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np

from quartzfold.operators import density, scores, validity

Pair = tuple[np.ndarray, np.ndarray]


def distinct_first(x: np.ndarray) -> np.ndarray:
    """Positions of the first of every group of equal rows, ascending."""
    return np.sort(np.unique(np.ascontiguousarray(x + 0.0), axis=0, return_index=True)[1])


def stratified_positions(labels: np.ndarray, size: int, seed: int) -> np.ndarray:
    """At most ``size`` positions, labels in proportion (largest remainder), each label once at least.

    Where a label has a single row, or there are more labels than places, a plain
    sample is drawn.
    """
    n = len(labels)
    if n <= size:
        return np.arange(n)
    rng = np.random.default_rng(seed)
    names, group = np.unique(labels, return_inverse=True)
    counts = np.bincount(group)
    if len(names) > size or counts.min() < 2:
        return np.sort(rng.permutation(n)[:size])
    share = counts * (size / n)
    quota = np.floor(share).astype(int)
    quota[np.argsort(-(share - quota), kind="stable")[: size - quota.sum()]] += 1
    chosen = [rng.permutation(np.flatnonzero(group == g))[:q] for g, q in enumerate(quota)]
    return np.sort(np.concatenate(chosen))


class Neighbours:
    """Neighbours of a fold, found once for the largest ``m``: of the training points (without themselves) and of the evaluated ones among them."""

    def __init__(self, train: np.ndarray, other: np.ndarray, m: int):
        self.train, self.other, self.m = train, other, m

    @cached_property
    def eval_nearest(self) -> Pair:
        """Distances and positions of the 2 m nearest training points of each evaluated point."""
        k = min(2 * self.m, len(self.train))
        x = self.train - self.train.mean(0)
        q, xx = self.other - self.train.mean(0), (x * x).sum(1)
        far, at = np.empty((len(q), k)), np.empty((len(q), k), int)
        wide = min(k + 3, len(x))
        for i in range(0, len(q), density.BLOCK):
            d = xx[None] - 2 * (q[i : i + density.BLOCK] @ x.T)
            near = np.sort(np.argpartition(d, wide - 1, axis=1)[:, :wide], axis=1)
            exact = np.sqrt(((x[near] - q[i : i + density.BLOCK, None]) ** 2).sum(2))
            order = np.argsort(exact, axis=1, kind="stable")[:, :k]
            far[i : i + density.BLOCK] = np.take_along_axis(exact, order, 1)
            at[i : i + density.BLOCK] = np.take_along_axis(near, order, 1)
        return far, at

    def train_distance(self, m: int) -> np.ndarray:
        """Distance to the m-th other training point."""
        return density.core_distances(self.train, min(m + 1, len(self.train)))

    def eval_distance(self, m: int) -> np.ndarray:
        return self.eval_nearest[0][:, min(m, len(self.train)) - 1]


class Fit:
    """A clustering of a fold's training part, with what the scores need."""

    def __init__(self, near: Neighbours, min_size: int, min_samples: int, tree: tuple[density.MergeTree, np.ndarray]):
        self.near, self.m, self.tree = near, min_samples, tree
        self.label, self.member, self.rows = density.hdbscan(near.train, min_size, min_samples, tree)

    @cached_property
    def glosh(self) -> Pair:
        parent, child, lam, _ = (np.array(v) for v in zip(*self.rows))
        own = scores.glosh_train(parent, child, lam)
        if not len(self.near.other):
            return own, np.zeros(0)
        far, at = self.near.eval_nearest
        k = min(2 * self.m, far.shape[1])
        return own, scores.glosh_new(parent, child, lam, self.tree[1], far[:, :k], at[:, :k], far[:, max(min(self.m, k) - 2, 0)])

    @cached_property
    def membership(self) -> Pair:
        _, p = density.approximate_predict(self.near.train, self.label, self.rows, self.tree[1], self.near.other, self.m)
        return 1 - self.member, 1 - p

    def degree(self, component: Pair) -> Pair:
        """Mean percentile rank of a component and of the distance to the min_samples-th neighbour."""
        return scores.degree_score(self.near.train_distance(self.m), self.near.eval_distance(self.m), *component)


SCORERS: dict[str, Callable[[Fit], Pair]] = {
    "glosh": lambda f: f.glosh,
    "manual_anomaly_score": lambda f: f.degree(f.membership),
    "manual_anomaly_score_glosh": lambda f: f.degree(f.glosh),
    # The training centre is the origin.
    "center_distance": lambda f: (np.linalg.norm(f.near.train, axis=1), np.linalg.norm(f.near.other, axis=1)),
}


def dbcv_sampled(x: np.ndarray, labels: np.ndarray, rows: int, seed: int) -> float:
    """DBCV on distinct points, at most ``rows`` of them, sampled by label."""
    first = distinct_first(x)
    chosen = first[stratified_positions(labels[first], rows, seed)]
    return validity.dbcv_score(x[chosen], labels[chosen])


#: Validity of a labelling: (points, labels, configuration, tree of the points for its DISCO parameter).
VALIDITY = {
    "dbcv": lambda x, label, config, tree: dbcv_sampled(x, label, config.dbcv_rows, config.seed),
    "disco": lambda x, label, config, tree: validity.disco_score(x, label, config.disco_points, tree),
}


def threshold(train: np.ndarray, rate: float, labels: np.ndarray | None = None, weight: float = 1.0) -> float:
    """The score above which the share ``rate`` of the training part lies.

    With a weight, rows of class 0 count that often, and it is the smallest score
    at which the weights reach the share 1 - rate.
    """
    if weight == 1.0:
        return float(np.quantile(train, 1 - rate))
    if labels is None:
        raise ValueError("a weighted threshold needs labels")
    return float(np.quantile(train, 1 - rate, weights=np.where(labels == 1, 1.0, weight), method="inverted_cdf"))


def step_average_precision(y: np.ndarray, score: np.ndarray) -> float:
    """Step-wise average precision over distinct scores; 0 without positives."""
    order = np.argsort(-score, kind="stable")
    y, s = y[order], score[order]
    last = np.r_[s[1:] != s[:-1], True][: len(s)]
    tp, n = np.cumsum(y)[last], (np.arange(len(y)) + 1)[last]
    return float((np.diff(np.r_[0, tp]) * tp / n).sum() / max(y.sum(), 1))


def alert_metrics(truth: np.ndarray, score: np.ndarray, at: float) -> dict[str, float]:
    """Counts and ratios of the alerts from a threshold on; a ratio without rows is 0."""
    hit, truth = score >= at, truth == 1
    tp, fp, fn = int((hit & truth).sum()), int((hit & ~truth).sum()), int((~hit & truth).sum())
    d = lambda u, v: u / v if v else 0.0
    return {"precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1": d(2 * tp, 2 * tp + fp + fn), "TP": tp, "FP": fp, "FN": fn}
