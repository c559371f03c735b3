"""Exact nearest neighbours: a query set against all rows, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that travel to all partitions at once.
BLOCK = 4_096
FOUND = "query bigint, id bigint, distance double"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float) if len(column) else np.zeros((0, 0))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, exact for equal points."""
    out = np.empty((len(q), len(x)))
    for i in range(len(q)):
        out[i] = np.sqrt(((x - q[i]) ** 2).sum(1))
    return out


def _scan(qid: np.ndarray, q: np.ndarray, k: int, include_self: bool):
    def run(batches):
        best: list[list[tuple[float, int]]] = [[] for _ in qid]
        for b in batches:
            ids, x = b.column("id").to_numpy(), _matrix(b.column("vector"))
            if not len(ids):
                continue
            # The product finds candidates, differences give the distances.
            d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T)
            if not include_self:
                d[qid[:, None] == ids[None]] = np.inf
            m = min(k, len(ids))
            edge = np.partition(d, m - 1, axis=1)[:, m - 1]
            near = d <= edge[:, None] + 1e-9 * (1 + np.abs(edge[:, None]))
            for i in range(len(qid)):
                at = np.flatnonzero(near[i] & np.isfinite(d[i]))
                exact = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
                best[i] = sorted(best[i] + list(zip(exact.tolist(), ids[at].tolist())))[:k]
        n = [len(r) for r in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array([r[1] for b in best for r in b], pa.int64()), pa.array([r[0] for b in best for r in b], pa.float64())], names=["query", "id", "distance"])

    return run


def knn(reference: DataFrame, queries: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """The k nearest rows of ``reference`` for each query: (query, rank, id, distance).

    Both have ``id`` (BIGINT, unique) and ``vector`` (ARRAY<DOUBLE>, one length);
    rows with a null vector are left out. Ranks count from 1, ties go to the
    smaller id. With ``include_self`` a row is its own neighbour at distance 0.
    """
    ready = reference.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    n = asked.count()
    blocks = max(1, math.ceil(n / BLOCK))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        rows = part.collect()  # one block
        if rows:
            found = ready.mapInArrow(_scan(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), k, include_self), FOUND)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], FOUND)
    near = out.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("near"))
    return near.select("query", F.posexplode("near").alias("p", "n")).select("query", (F.col("p") + 1).alias("rank"), F.col("n.id").alias("id"), F.col("n.distance").alias("distance"))


def core_distance(neighbours: DataFrame, m: int) -> DataFrame:
    """Distance to the m-th neighbour as ranked by :func:`knn`: (id, core)."""
    return neighbours.where(F.col("rank") == m).select(F.col("query").alias("id"), F.col("distance").alias("core"))


def mutual_reachability(neighbours: DataFrame, core: DataFrame) -> DataFrame:
    """Adds ``reach``: the largest of both core distances and the distance."""
    a = core.select(F.col("id").alias("query"), F.col("core").alias("core_a"))
    b = core.select("id", F.col("core").alias("core_b"))
    return neighbours.join(a, "query").join(b, "id").select("query", "rank", "id", "distance", F.greatest("core_a", "core_b", "distance").alias("reach"))


def nearest_core(cores: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """Cluster and distance of the nearest core point: (id, label, distance); label -1 beyond ``eps``.

    ``cores`` has id, vector and label. Without cores all points get -1 and 0.
    """
    near = knn(cores, points, 1, include_self=True).join(cores.select("id", "label"), "id").select(F.col("query").alias("id"), F.when(F.col("distance") <= eps, F.col("label")).otherwise(-1).alias("label"), "distance")
    return points.select("id").join(near, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("distance", F.lit(0.0)).alias("distance"))
