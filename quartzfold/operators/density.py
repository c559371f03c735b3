"""Density trees and clusterings of one group of points (NumPy kernels).

They are sequential by nature and run inside one Arrow group per (fold, combo);
memory is linear in the points, time quadratic.
"""

from __future__ import annotations

import numpy as np


#: Rows whose distances to all points are held at once.
BLOCK = 256


def core_distances(x: np.ndarray, m: int) -> np.ndarray:
    """Distance to the m-th neighbour, the point itself being the first."""
    n = len(x)
    if not 1 <= m <= n:
        raise ValueError("min_points must be between 1 and the number of points")
    x = x - x.mean(0)
    xx, out = (x * x).sum(1), np.empty(n)
    # A product gives the distances up to rounding; the few around the m-th are then taken exactly.
    k = min(m + 3, n)
    for i in range(0, n, BLOCK):
        d = xx[None] - 2 * (x[i : i + BLOCK] @ x.T)
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), d.shape)
        exact = ((x[near] - x[i : i + BLOCK, None]) ** 2).sum(2)
        out[i : i + BLOCK] = np.partition(exact, m - 1, axis=1)[:, m - 1]
    return np.sqrt(out)


def spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of mutual reachability, edges in ascending order: (a, b, weight)."""
    n = len(x)
    y = x - x.mean(0) if n else x
    own, a, b = core * core, np.zeros(max(n - 1, 0), int), np.zeros(max(n - 1, 0), int)
    # Points still outside, always in the first rows: one that joins is overwritten by the last.
    ids, p, link = np.arange(1, n), y[1:].copy(), np.zeros(max(n - 1, 0), int)
    pp, pc, best = (p * p).sum(1), own[1:].copy(), np.full(max(n - 1, 0), np.inf)
    now = 0
    for step in range(n - 1):
        left = n - 1 - step
        reach = pp[:left] + (y[now] @ y[now] - 2 * (p[:left] @ y[now]))
        np.maximum(reach, pc[:left], out=reach)
        np.maximum(reach, own[now], out=reach)
        nearer = reach < best[:left]
        np.copyto(link[:left], now, where=nearer)
        np.minimum(best[:left], reach, out=best[:left])
        k = int(np.argmin(best[:left]))
        a[step], b[step] = link[k], ids[k]
        now = int(ids[k])
        for held in (ids, p, pp, pc, best, link):
            held[k] = held[left - 1]
    w = np.maximum(np.maximum(np.sqrt(((x[a] - x[b]) ** 2).sum(1)), core[a]), core[b])
    order = np.argsort(w, kind="stable")
    return a[order], b[order], w[order]


class MergeTree:
    """Binary merge tree of a spanning tree: nodes 0..n-1 are points, the last one is the root."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        n = len(w) + 1
        self.n, self.height = n, np.r_[np.zeros(n), w]
        self.left, self.right = np.full(2 * n - 1, -1), np.full(2 * n - 1, -1)
        root, node = np.arange(n), np.arange(n)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for k in range(n - 1):
            i, j = find(a[k]), find(b[k])
            self.left[n + k], self.right[n + k] = node[i], node[j]
            root[j], node[i] = i, n + k

    def to_groups(self, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum and minimum of the density-connectivity distance of every point to every group, itself left out.

        ``group`` is -1 for points in none.
        """
        n, last = self.n, 2 * self.n - 2
        count = np.zeros((2 * n - 1, groups))
        count[np.flatnonzero(group >= 0), group[group >= 0]] = 1
        for v in range(n, 2 * n - 1):
            count[v] = count[self.left[v]] + count[self.right[v]]
        total, least = np.zeros((2 * n - 1, groups)), np.full((2 * n - 1, groups), np.inf)
        for v in range(last, n - 1, -1):
            l, r, h = self.left[v], self.right[v], self.height[v]
            total[l], total[r] = total[v] + h * count[r], total[v] + h * count[l]
            least[l], least[r] = np.where(count[r] > 0, np.minimum(least[v], h), least[v]), np.where(count[l] > 0, np.minimum(least[v], h), least[v])
        return total[:n], least[:n]


def density_tree(x: np.ndarray, m: int = 5) -> tuple[MergeTree, np.ndarray]:
    """Merge tree and core distances of points."""
    x = np.asarray(x, float)
    core = core_distances(x, m)
    return MergeTree(*spanning_tree(x, core)), core


def condense(tree: MergeTree, min_size: int) -> list[tuple[int, int, float, int]]:
    """Condensed tree: rows (parent, child, lambda, child size); the root is n, clusters follow."""
    n = tree.n
    size = np.ones(2 * n - 1, int)
    for v in range(n, 2 * n - 1):
        size[v] = size[tree.left[v]] + size[tree.right[v]]
    rows: list[tuple[int, int, float, int]] = []
    fresh = n
    stack = [(2 * n - 2, n)]

    def leaves(v: int):
        todo = [v]
        while todo:
            u = todo.pop()
            if u < n:
                yield u
            else:
                todo += [tree.right[u], tree.left[u]]

    while stack:
        v, cluster = stack.pop()
        if v < n:
            rows.append((cluster, int(v), np.inf, 1))
            continue
        lam = 1 / tree.height[v] if tree.height[v] > 0 else np.inf
        l, r = tree.left[v], tree.right[v]
        if size[l] >= min_size and size[r] >= min_size:
            for c in (l, r):
                fresh += 1
                rows.append((cluster, fresh, lam, int(size[c])))
                stack.append((c, fresh))
        else:
            for c in (l, r):
                if size[c] >= min_size:
                    stack.append((c, cluster))
                else:
                    rows += [(cluster, int(p), lam, 1) for p in leaves(c)]
    return rows


def extract(rows: list[tuple[int, int, float, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise) and membership by excess of mass; the root is no cluster."""
    birth = {n: 0.0} | {c: lam for _, c, lam, _ in rows if c >= n}
    stability = dict.fromkeys(birth, 0.0)
    children: dict[int, list[int]] = {}
    for p, c, lam, size in rows:
        gain = 0.0 if lam == birth[p] else lam - birth[p]
        stability[p] += gain * size
        if c >= n:
            children.setdefault(p, []).append(c)
    chosen: set[int] = set()
    for c in sorted(birth, reverse=True):
        if c == n:
            continue
        below = sum(stability[k] for k in children.get(c, []))
        if children.get(c) and below > stability[c]:
            stability[c] = below
        else:
            todo = list(children.get(c, []))
            while todo:
                k = todo.pop()
                chosen.discard(k)
                todo += children.get(k, [])
            chosen.add(c)
    number = {c: i for i, c in enumerate(sorted(chosen))}
    parent = {c: p for p, c, _, _ in rows if c >= n}
    owner: dict[int, int] = {}
    for c in sorted(birth):
        owner[c] = number[c] if c in number else owner.get(parent.get(c, -1), -1)
    label, lam_of = np.full(n, -1), np.zeros(n)
    for p, c, lam, _ in rows:
        if c < n:
            label[c], lam_of[c] = owner[p], lam
    top = np.zeros(max(len(number), 1))
    for p, c, lam, _ in rows:
        if owner[p] >= 0:
            top[owner[p]] = max(top[owner[p]], lam)
    member = np.zeros(n)
    for i in np.flatnonzero(label >= 0):
        t = top[label[i]]
        member[i] = 1.0 if not np.isfinite(lam_of[i]) or t == 0 else min(lam_of[i], t) / t if np.isfinite(t) else 0.0
    return label, member


def hdbscan(x: np.ndarray, min_size: int, min_samples: int, tree: tuple[MergeTree, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """Labels, membership and condensed tree; a density tree of these points and samples can be passed."""
    rows = condense((tree or density_tree(x, min_samples))[0], min_size)
    return *extract(rows, len(x)), rows


def components(x: np.ndarray, eps: float, m: int) -> np.ndarray:
    """Core points at a radius by connected component, labelled by the smallest member; -1 elsewhere."""
    core = core_distances(x, m)
    label = np.where(core <= eps, np.arange(len(x)), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(label >= 0):
            near = (label >= 0) & (((x - x[i]) ** 2).sum(1) <= eps * eps)
            new[i] = new[near].min()
        if (new == label).all():
            return label
        label = new


def dbscan(x: np.ndarray, eps: float, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels (border points join their nearest core's cluster) and which points are core."""
    label = components(x, eps, m)
    core = np.flatnonzero(label >= 0)
    out = label.copy()
    for i in np.flatnonzero(label < 0):
        if len(core):
            d = ((x[core] - x[i]) ** 2).sum(1)
            if d.min() <= eps * eps:
                out[i] = label[core[np.argmin(d)]]
    return out, label >= 0


def approximate_predict(x: np.ndarray, label: np.ndarray, rows: list[tuple[int, int, float, int]], core: np.ndarray, new: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Label and membership of unseen points by their best mutual-reachability neighbour among 2 m.

    A point is noise if it would join before its neighbour's cluster was born.
    """
    root = min(p for p, *_ in rows)
    birth = {c: lam for _, c, lam, _ in rows if c >= root}
    up = {c: p for p, c, _, _ in rows if c >= root}
    of = {c: p for p, c, _, _ in rows if c < root}
    lam_of = {c: lam for _, c, lam, _ in rows if c < root}
    # The chosen cluster of a label: the highest ancestor whose points all have that label.
    start: dict[int, float] = {}
    top: dict[int, float] = {}
    for i, l in enumerate(label):
        if l >= 0:
            top[l] = max(top.get(l, 0.0), lam_of[i])
    members: dict[int, set[int]] = {}
    for i, l in enumerate(label):
        k = of[i]
        while k is not None:
            members.setdefault(k, set()).add(int(l))
            k = up.get(k)
    for k, labels in members.items():
        if len(labels) == 1 and k != root:
            l = next(iter(labels))
            if l >= 0:
                start[l] = min(start.get(l, np.inf), birth[k])
    out, prob = np.full(len(new), -1), np.zeros(len(new))
    k = min(2 * m, len(x))
    for i, p in enumerate(new):
        d = np.sqrt(((x - p) ** 2).sum(1))
        near = np.argpartition(d, k - 1)[:k]
        own = np.sort(d[near])[min(m, k) - 1]
        reach = np.maximum(np.maximum(d[near], core[near]), own)
        j = near[np.argmin(reach)]
        lam = 1 / reach.min() if reach.min() > 0 else np.inf
        l = int(label[j])
        if l >= 0 and lam >= start.get(l, 0.0):
            out[i] = l
            prob[i] = 1.0 if not np.isfinite(lam) or top[l] == 0 else min(lam, top[l]) / top[l] if np.isfinite(top[l]) else 0.0
    return out, prob
