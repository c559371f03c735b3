"""Mergeable percentiles with a certified rank error.

A summary of a group is a short sorted list of values, each with the lowest and
the highest rank it may have in the group (deterministic rank intervals in the
manner of Greenwald and Khanna). Partitions make summaries of their own rows,
summaries are merged in a tree of fixed fan-in, and after each step a summary is
compressed to ``budget`` values. Every step keeps the rank intervals valid, so
the error of an answer is read off the summary instead of being assumed.

Summary columns: ``key`` (JSON of the group columns), ``n`` (rows), ``v``
(values), ``lo`` and ``hi`` (rank intervals, from 1), ``exact`` (no value was
ever dropped, so every ``v`` stands for the ranks ``lo`` to ``hi`` it fills).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMMARY = "key string, part int, n bigint, exact boolean, v array<double>, lo array<bigint>, hi array<bigint>"
#: Summaries joined by one merge step.
FAN_IN = 64
#: Rows held by a Python worker before it condenses them.
BUFFER_ROWS = 500_000


def budget_for(epsilon: float, steps: int) -> int:
    """Values per summary so that ``steps`` compressions add up to ``epsilon``."""
    return max(4, math.ceil(steps / epsilon))


def _runs(codes: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal codes, and the end."""
    return np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes)] if len(codes) else np.zeros(1, int)


def expand(v: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Exact runs of ties as their first and last occurrence."""
    times = 1 + (hi > lo)
    at = np.repeat(np.arange(len(v)), times)
    last = np.r_[at[1:] != at[:-1], True] if len(at) else np.zeros(0, bool)
    first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    return v[at], np.where(first, lo[at], hi[at]), np.where(last, hi[at], lo[at])


def compress(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, budget: int):
    """Keep at most ``budget`` tuples, the first and the last among them."""
    if len(v) <= budget:
        return v, lo, hi
    targets = 1 + (n - 1) * np.arange(budget) / (budget - 1)
    middle = (lo + hi) / 2
    at = np.clip(np.searchsorted(middle, targets), 1, len(v) - 1)
    at -= targets - middle[at - 1] < middle[at] - targets
    at[0], at[-1] = 0, len(v) - 1
    at = np.unique(at)
    return v[at], lo[at], hi[at]


def merge(parts: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray, int]]):
    """Join summaries; the rank intervals of the result hold for all their rows."""
    values = np.concatenate([p[0] for p in parts])
    lo = np.concatenate([p[1] for p in parts]).astype(np.int64)
    hi = np.concatenate([p[2] for p in parts]).astype(np.int64)
    own = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    for k, (v, l, h, n) in enumerate(parts):
        other = own != k
        x = values[other]
        below = np.searchsorted(v, x, "right")
        lo[other] += np.r_[0, l][below]
        hi[other] += np.r_[h - 1, n][np.searchsorted(v, x, "right")]
    order = np.lexsort((hi, lo, values))
    return values[order], lo[order], hi[order], sum(p[3] for p in parts)


def _condense(codes: np.ndarray, v: np.ndarray, weight: np.ndarray, budget: int):
    """Summaries of all groups of exact values at once: offsets and columns."""
    order = np.lexsort((v, codes))
    codes, v, weight = codes[order], v[order], weight[order]
    new = np.ones(len(v), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    weight = np.add.reduceat(weight, at)
    codes, v = codes[at], v[at]
    starts = _runs(codes)
    total = np.cumsum(weight)
    before = np.r_[0, total][starts[:-1]]
    sizes = np.diff(starts)
    hi = total - np.repeat(before, sizes)
    lo = hi - weight + 1
    n = np.r_[0, total][starts[1:]] - before
    out = []
    for g, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        small = b - a <= budget
        part = (v[a:b], lo[a:b], hi[a:b]) if small else compress(*expand(v[a:b], lo[a:b], hi[a:b]), int(n[g]), budget)
        out.append((int(codes[a]), int(n[g]), small, *part))
    return out


def _table(keys: list[str], part: int, rows: list) -> pa.RecordBatch:
    ends = np.r_[0, np.cumsum([len(r[3]) for r in rows])].astype(np.int32)
    cat = lambda i, t: np.concatenate([r[i] for r in rows]).astype(t) if rows else np.zeros(0, t)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(cat(i, t))) for i, t in ((3, float), (4, np.int64), (5, np.int64))]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array(np.full(len(rows), part, np.int32)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), *lists],
        names=["key", "part", "n", "exact", "v", "lo", "hi"],
    )


def _leaf(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            coded = t.column("key").combine_chunks().dictionary_encode()
            rows = _condense(coded.indices.to_numpy(), t.column("value").to_numpy(), np.ones(len(t), np.int64), budget)
            names = coded.dictionary.to_pylist()
            return _table([names[r[0]] for r in rows], part, rows)

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= BUFFER_ROWS:
                yield flush()
                held = []
        if held:
            yield flush()

    return run


def _merge_sorted(budget: int, fan_in: int):
    """Merge the summaries of each (key, part) run of a sorted partition."""

    def join(rows: list[tuple]) -> list:
        if len(rows) == 1:
            return [rows[0][2], rows[0][3], *rows[0][4:]]
        if all(r[3] for r in rows):
            v = np.concatenate([r[4] for r in rows])
            w = np.concatenate([r[6] - r[5] + 1 for r in rows])
            _, n, small, *rest = _condense(np.zeros(len(v), np.int64), v, w, budget)[0]
            return [n, small, *rest]
        v, lo, hi, n = merge([(*(expand(*r[4:]) if r[3] else r[4:]), r[2]) for r in rows])
        return [n, False, *compress(v, lo, hi, n, budget)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        keys, parts, out = [], [], []

        def close():
            keys.append(held[0][0])
            parts.append(held[0][1])
            out.append((0, *join(held)))

        def table():
            b = _table(keys, 0, out)
            return b.set_column(1, "part", pa.array(np.array(parts, np.int32)))

        for b in batches:
            key, part = b.column("key").to_pylist(), b.column("part").to_numpy()
            n, exact = b.column("n").to_numpy(), b.column("exact").to_pylist()
            ends = b.column("v").offsets.to_numpy()
            base = ends[0]
            v, lo, hi = (b.column(c).flatten().to_numpy() for c in ("v", "lo", "hi"))
            for i in range(b.num_rows):
                s = slice(ends[i] - base, ends[i + 1] - base)
                row = (key[i], int(part[i]), int(n[i]), exact[i], v[s], lo[s], hi[s])
                if held and held[0][:2] != row[:2]:
                    close()
                    held = []
                elif len(held) >= fan_in:
                    held = [(*held[0][:2], *join(held))]
                held.append(row)
            if len(out) >= 2000:
                yield table()
                keys, parts, out = [], [], []
        if held:
            close()
        if out:
            yield table()

    return run


def summarize(df: DataFrame, keys: Sequence[str], value: str, epsilon: float = 0.005) -> DataFrame:
    """One summary per group of ``keys``: rank intervals of at most ``2/epsilon`` values.

    Nulls and NaN are left out (a group with nothing else has no summary);
    infinities are ranked. Null keys form a group of their own. Any rank asked
    of the result is off by at most ``epsilon * n``. An empty table gives none.
    """
    ready = df.select(F.to_json(F.struct(*[F.col(k) for k in keys])).alias("key"), F.col(value).cast("double").alias("value"))
    ready = ready.where(F.col("value").isNotNull() & ~F.isnan("value"))
    leaves = ready.rdd.getNumPartitions()
    levels = max(1, math.ceil(math.log(max(leaves, 2), FAN_IN)))
    budget = budget_for(epsilon, levels + 1)
    return merge_summaries(ready.mapInArrow(_leaf(budget), SUMMARY), levels, budget)


def merge_summaries(summaries: DataFrame, levels: int = 1, budget: int | None = None, epsilon: float = 0.005) -> DataFrame:
    """Merge summaries with equal ``key`` through a tree of fixed fan-in.

    Use it to join days or partitions: map ``key`` to the coarser group first
    (see :func:`regroup`) and merge.
    """
    budget = budget or budget_for(epsilon, levels)
    out = summaries
    for _ in range(levels):
        out = out.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        out = out.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_merge_sorted(budget, FAN_IN), SUMMARY)
    return out


def regroup(summaries: DataFrame, schema: str, keys: Sequence[str]) -> DataFrame:
    """The summaries under a coarser key made of ``keys`` of the JSON key."""
    k = F.from_json("key", schema)
    part = F.pmod(F.xxhash64("key"), F.lit(FAN_IN * FAN_IN)).cast("int")
    return summaries.select(F.to_json(F.struct(*[k[c].alias(c) for c in keys])).alias("key"), part.alias("part"), "n", "exact", "v", "lo", "hi")


def answer(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, rank: int) -> tuple[float, int]:
    """The value of least uncertainty at a rank, and how far off its rank may be."""
    starts = _runs(v)[:-1]
    off = np.maximum(np.maximum(rank - np.maximum.reduceat(lo, starts), np.minimum.reduceat(hi, starts) - rank), 0)
    i = int(np.argmin(off))
    return float(v[starts[i]]), int(off[i])


def percentiles(summaries: DataFrame, schema: str, probabilities: dict[str, float]) -> DataFrame:
    """Ask summaries for percentiles: a column per probability and ``rank_error``.

    The percentile p of n rows is the value of rank ``max(1, ceil(p*n))``.
    ``rank_error`` bounds the distance in rows of every answer's rank from the
    wanted rank, as read off the rank intervals; 0 means exact answers.
    """
    names = list(probabilities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, exact = b.column("n").to_numpy(), b.column("exact").to_pylist()
            ends = b.column("v").offsets.to_numpy()
            base = ends[0] if len(ends) else 0
            v, lo, hi = (b.column(c).flatten().to_numpy() for c in ("v", "lo", "hi"))
            got, worst = {p: [] for p in names}, []
            for i in range(b.num_rows):
                s = slice(ends[i] - base, ends[i + 1] - base)
                far = 0
                for p in names:
                    rank = max(1, math.ceil(probabilities[p] * int(n[i]) - 1e-9))
                    if exact[i]:
                        got[p].append(float(v[s][np.searchsorted(hi[s], rank)]))
                    else:
                        x, off = answer(v[s], lo[s], hi[s], int(n[i]), rank)
                        got[p].append(x)
                        far = max(far, off)
                worst.append(far)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), *[pa.array(got[p], pa.float64()) for p in names], pa.array(worst, pa.int64())], names=["key", "n", *names, "rank_error"])

    out = summaries.mapInArrow(run, "key string, n bigint, " + ", ".join(f"{p} double" for p in names) + ", rank_error bigint")
    fields = T._parse_datatype_string(schema).fieldNames()
    k = F.from_json("key", schema)
    return out.select(*[k[c].alias(c) for c in fields], "n", *names, "rank_error")
