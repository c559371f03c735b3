"""Label-free validity of a clustering: DISCO and DBCV (NumPy kernels)."""

from __future__ import annotations

import warnings

import numpy as np

from quartzfold.operators.density import MergeTree, density_tree, spanning_tree


def gap(a, b):
    """(a - b) / max(a, b), 0 where both are 0."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    top = np.maximum(a, b)
    return np.divide(a - b, top, out=np.zeros(top.shape), where=top > 0)


def disco_samples(x: np.ndarray, labels: np.ndarray, min_points: int = 5, tree: tuple[MergeTree, np.ndarray] | None = None) -> np.ndarray:
    """DISCO score of every point; noise is labelled -1.

    Without clusters all scores are -1; with one cluster and no noise all are 0.
    """
    x, labels = np.asarray(x, float), np.asarray(labels)
    if len(x) != len(labels):
        raise ValueError("points and labels differ in number")
    if not 1 <= min_points <= len(x):
        raise ValueError("min_points must be between 1 and the number of points")
    if tree is not None and tree[0].n != len(x):
        raise ValueError("the tree belongs to other points")
    names, group = np.unique(labels[labels != -1], return_inverse=True)
    noise, k = labels == -1, len(names)
    if k == 0:
        return np.full(len(x), -1.0)
    if k == 1 and not noise.any():
        return np.zeros(len(x))
    merge, core = tree or density_tree(x, min_points)
    own = np.full(len(x), k)
    own[~noise] = group
    total, least = merge.to_groups(own, k + 1)
    size = np.bincount(group, minlength=k)
    out = np.zeros(len(x))
    at = np.flatnonzero(~noise & (size[np.minimum(own, k - 1)] > 1))
    mine = total[at, own[at]] / (size[own[at]] - 1)
    if k == 1:
        other = least[at, k]
    else:
        mean = total[at, :k] / size
        mean[np.arange(len(at)), own[at]] = np.inf
        other = mean.min(1)
    out[at] = gap(other, mine)
    if noise.any():
        widest = np.array([core[own == c].max() for c in range(k)])
        sparse = gap(core[noise][:, None], widest[None])
        far = gap(least[noise][:, :k], np.broadcast_to(widest, (noise.sum(), k)))
        out[noise] = np.minimum(sparse, far).min(1)
    return out


def disco_score(x: np.ndarray, labels: np.ndarray, min_points: int = 5, tree=None) -> float:
    """Mean DISCO score."""
    return float(disco_samples(x, labels, min_points, tree).mean())


def dbcv_score(x: np.ndarray, labels: np.ndarray) -> float:
    """Density-based validity: separation against sparseness, weighted by cluster size; -1 without clusters.

    A failure is reported by a warning and gives -1.
    """
    x, labels = np.asarray(x, float), np.asarray(labels)
    names = np.unique(labels[labels != -1])
    if not len(names):
        return -1.0
    try:
        d = x.shape[1]
        inner, cores, sparse = [], [], []
        for c in names:
            y = x[labels == c]
            core = np.zeros(len(y))
            for i in range(len(y)):
                r = np.sqrt(((y - y[i]) ** 2).sum(1))
                r = r[np.arange(len(y)) != i]
                if len(r) and r.min() > 0:
                    # In logarithms: distances to the power of the dimension overflow.
                    e = -d * np.log(r)
                    core[i] = np.exp(-(e.max() + np.log(np.exp(e - e.max()).mean())) / d)
            if len(y) < 2:
                inner.append(y), cores.append(core), sparse.append(0.0)
                continue
            a, b, w = spanning_tree(y, core)
            degree = np.bincount(np.r_[a, b], minlength=len(y))
            inside = degree > 1
            edges = inside[a] & inside[b]
            sparse.append(w[edges].max() if edges.any() else w.max())
            keep = inside if inside.any() else np.ones(len(y), bool)
            inner.append(y[keep]), cores.append(core[keep])
        score = 0.0
        for i in range(len(names)):
            sep = np.inf
            for j in range(len(names)):
                if i != j:
                    for p, q in zip(inner[i], cores[i]):
                        r = np.sqrt(((inner[j] - p) ** 2).sum(1))
                        sep = min(sep, np.maximum(np.maximum(r, cores[j]), q).min())
            if np.isfinite(sep):
                score += (labels == names[i]).sum() / len(labels) * float(gap(sep, sparse[i]))
        return score
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"no validity: {e}", stacklevel=2)
        return -1.0
