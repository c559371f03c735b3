"""Anomaly scores: percentile ranks, ensembles and the condensed-tree score."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.functions.ordering import running
from quartzfold.session import materialize


def percentile_rank(reference: DataFrame, values: DataFrame, column: str, by: Sequence[str] = (), name: str = "percentile_rank") -> DataFrame:
    """Adds to ``values`` the share of reference rows of the group that are not larger; null without any."""
    k = "__v"
    r = reference.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias(k)).agg(F.count("*").alias("n"))
    v = values.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias(k)).distinct().withColumn("n", F.lit(0).cast("bigint"))
    steps = running(r.unionByName(v).groupBy(*by, k).agg(F.sum("n").alias("n")), by, k, ["n"])
    if by:
        steps = steps.join(r.groupBy(*by).agg(F.sum("n").alias("__all")), list(by), "left")
    else:
        steps = steps.withColumn("__all", F.lit(r.agg(F.sum("n")).first()[0]).cast("bigint"))
    share = steps.select(*by, k, F.try_divide("cum_n", "__all").alias(name))
    return values.withColumn(k, F.col(column).cast("double")).join(share, [*by, k], "left").drop(k)


def ensemble(df: DataFrame, ranks: Sequence[str], name: str = "score") -> DataFrame:
    """Adds the mean of percentile ranks."""
    return df.withColumn(name, sum((F.col(c) for c in ranks), F.lit(0.0)) / len(ranks))


def lambda_max(parent: np.ndarray, child: np.ndarray, lam: np.ndarray) -> dict[int, float]:
    """The largest lambda of a point below each cluster of a condensed tree."""
    root = int(parent.min())
    up = {int(c): int(p) for p, c in zip(parent, child) if c >= root}
    top: dict[int, float] = {int(c): 0.0 for c in np.unique(np.r_[parent, child[child >= root]])}
    for p, c, l in zip(parent, child, lam):
        if c < root:
            k = int(p)
            while k is not None and top[k] < l:
                top[k] = float(l)
                k = up.get(k)
    return top


def glosh_value(lam, top):
    """1 - lambda / lambda_max, and 0 where lambda is infinite or lambda_max is 0."""
    lam, top = np.asarray(lam, float), np.asarray(top, float)
    out = np.zeros(np.broadcast(lam, top).shape)
    ok = np.isfinite(lam) & (top > 0)
    with np.errstate(invalid="ignore"):
        out[ok] = (1 - np.broadcast_to(lam, out.shape) / np.broadcast_to(top, out.shape))[ok]
    return out


def glosh_train(parent: np.ndarray, child: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """GLOSH of the points 0..n-1 of a condensed tree; every point must occur exactly once."""
    parent, child, lam = np.asarray(parent), np.asarray(child), np.asarray(lam, float)
    root = int(parent.min())
    point = child < root
    if sorted(child[point].tolist()) != list(range(root)):
        raise ValueError("every point needs exactly one row")
    top = lambda_max(parent, child, lam)
    order = np.argsort(child[point])
    return glosh_value(lam[point][order], np.array([top[int(p)] for p in parent[point][order]]))


def glosh_new(parent, child, lam, train_core: np.ndarray, distance: np.ndarray, index: np.ndarray, new_core: np.ndarray) -> np.ndarray:
    """GLOSH of new points by their neighbours among the training points.

    A neighbour y gives min(1 / mutual reachability, lambda of y); the best one
    decides the cluster, which is left for its parent while it was born later.
    """
    parent, child, lam = np.asarray(parent), np.asarray(child), np.asarray(lam, float)
    root = int(parent.min())
    point = child < root
    own, of = np.zeros(root), np.zeros(root, int)
    own[child[point]], of[child[point]] = lam[point], parent[point]
    birth = {int(c): float(l) for c, l in zip(child[~point], lam[~point])}
    up = {int(c): int(p) for p, c in zip(parent[~point], child[~point])}
    top = lambda_max(parent, child, lam)
    reach = np.maximum(np.maximum(distance, train_core[index]), new_core[:, None])
    with np.errstate(divide="ignore"):
        best = np.minimum(np.where(reach > 0, 1 / np.where(reach > 0, reach, 1), np.inf), own[index])
    at = best.argmax(1)
    out = np.zeros(len(index))
    for i in range(len(index)):
        l, c = best[i, at[i]], int(of[index[i, at[i]]])
        while birth.get(c, 0.0) > l and c in up:
            c = up[c]
        out[i] = glosh_value(l, top[c])
    return out


def degree_score(train_distance: np.ndarray, eval_distance: np.ndarray, train_component: np.ndarray, eval_component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean percentile rank, against training, of the neighbour distance and of a component score."""
    rank = lambda r, v: np.searchsorted(np.sort(r), v, "right") / len(r)
    return ((rank(train_distance, train_distance) + rank(train_component, train_component)) / 2, (rank(train_distance, eval_distance) + rank(train_component, eval_component)) / 2)


def _rooted(tree: DataFrame, by: Sequence[str]) -> DataFrame:
    root = tree.groupBy(*by).agg(F.min("parent").alias("root"))
    return tree.join(root, list(by)) if by else tree.withColumn("root", F.lit(root.first()[0]).cast("bigint"))


def ancestors(tree: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every cluster of condensed trees with itself and all clusters above it: (by.., cluster, ancestor, steps, birth).

    ``tree`` has the keys ``by``, parent, child and lam; a child below the
    smallest parent of its tree is a point. One round per level of the trees,
    over clusters only. ``birth`` is the lambda at which the ancestor split off,
    0 for the root.
    """
    root = tree.groupBy(*by).agg(F.min("parent").alias("root"))
    edges = _rooted(tree, by).where(F.col("child") >= F.col("root"))
    edges = materialize(edges.select(*by, F.col("child").alias("ancestor"), F.col("parent").alias("up"), F.col("lam").alias("birth")), "clusters")
    front = edges.select(*by, F.col("ancestor").alias("cluster")).unionByName(root.select(*by, F.col("root").alias("cluster"))).withColumns({"ancestor": F.col("cluster"), "steps": F.lit(0)})
    levels = []
    while True:
        front = materialize(front, "ancestors")
        levels.append(front)
        if front.isEmpty():
            break
        front = front.join(edges, [*by, "ancestor"]).select(*by, "cluster", F.col("up").alias("ancestor"), (F.col("steps") + 1).alias("steps"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.join(edges.drop("up"), [*by, "ancestor"], "left").withColumn("birth", F.coalesce("birth", F.lit(0.0)))


def tree_points(tree: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of the points of condensed trees: (by.., point, cluster, lam)."""
    return _rooted(tree, by).where(F.col("child") < F.col("root")).select(*by, F.col("child").alias("point"), F.col("parent").alias("cluster"), "lam")


def lambda_max_rows(tree: DataFrame, by: Sequence[str] = (), above: DataFrame | None = None) -> DataFrame:
    """:func:`lambda_max` over tables: (by.., cluster, lambda_max); 0 for a cluster without points."""
    above = ancestors(tree, by) if above is None else above
    # Points are many, clusters few: the maximum per cluster comes before the join.
    own = tree_points(tree, by).groupBy(*by, "cluster").agg(F.max("lam").alias("top"))
    tops = above.join(own, [*by, "cluster"], "left").groupBy(*by, F.col("ancestor").alias("cluster"))
    return tops.agg(F.coalesce(F.max("top"), F.lit(0.0)).alias("lambda_max"))


def _glosh(lam: str, top: str):
    infinite = F.col(lam) == float("inf")
    return F.when(infinite | (F.col(top) <= 0), 0.0).otherwise(1 - F.try_divide(lam, top))


def glosh_rows(tree: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """GLOSH of all points of condensed trees: (by.., point, glosh)."""
    return tree_points(tree, by).join(lambda_max_rows(tree, by), [*by, "cluster"]).select(*by, "point", _glosh("lam", "lambda_max").alias("glosh"))


def glosh_new_rows(tree: DataFrame, neighbours: DataFrame, train_core: DataFrame, new_core: DataFrame) -> DataFrame:
    """:func:`glosh_new` over tables: (query, cluster, glosh).

    ``neighbours`` has query, rank, id (a point of the tree) and distance; the
    cores have id and core. The neighbour of the highest lambda decides, ties by
    rank; its cluster is left for the nearest one above it that was born early enough.
    """
    above = ancestors(tree)
    points = tree_points(tree).withColumnRenamed("point", "id")
    x = neighbours.join(points, "id").join(train_core.select("id", "core"), "id").join(new_core.select(F.col("id").alias("query"), F.col("core").alias("own")), "query")
    reach = F.greatest("distance", "core", "own")
    x = x.withColumn("lam", F.least(F.when(reach > 0, 1 / F.nullif(reach, F.lit(0.0))).otherwise(float("inf")), F.col("lam")))
    best = x.groupBy("query").agg(F.min_by(F.struct("lam", "cluster"), F.struct(-F.col("lam"), F.col("rank"))).alias("b")).select("query", "b.*")
    at = best.join(above, "cluster").where(F.col("birth") <= F.col("lam")).groupBy("query", "lam").agg(F.min_by("ancestor", "steps").alias("cluster"))
    return at.join(lambda_max_rows(tree, above=above), "cluster").select("query", "cluster", _glosh("lam", "lambda_max").alias("glosh"))
