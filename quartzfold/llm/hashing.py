"""Most similar vectors, by multi-index hashing.

Vectors get binary codes: the signs of their projections on rotations that were
learned on a bounded sample (principal axes, then iterative quantisation). A
code is split into substrings, each with an index of its own. With m substrings,
codes within Hamming distance m (r + 1) - 1 of a query agree with it up to r
bits in at least one substring (pigeonhole), so probing a query's own bucket and
those up to r bits away, in all indexes, retrieves all of them; the floats of
what the buckets hold then decide. Substrings get longer with the collection, so
that buckets do not grow with it; where the dimensions do not suffice for all
substrings, each gets a rotation of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.session import materialize

#: Rows of the sample on which the rotation is learned.
SAMPLE_ROWS = 20_000
#: Substrings, and bits of one that may differ.
SUBSTRINGS, RADIUS = 2, 2
#: Larger buckets are searched for copies first, and by distance from their centre.
LARGE_BUCKET = 4_096
#: Indexed vectors that one task should hold.
TASK_ROWS = 100_000
#: Queries that travel to all partitions at once when they are answered exactly.
BLOCK = 8_192


def learn(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Centre and rotation (dimensions x bits) of the codes."""
    centre = np.median(sample, axis=0)
    x = sample - centre
    far = np.linalg.norm(x, axis=1)
    x = x[far <= np.quantile(far, 0.98)]
    _, axes = np.linalg.eigh(x.T @ x / max(len(x), 1))
    p = x @ axes[:, ::-1][:, :bits]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
        turn = (u @ vt).T
    return centre, axes[:, ::-1][:, :bits] @ turn


def rotations(sample: np.ndarray, bits: int, substrings: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and the rotations of all substrings side by side, ``bits`` columns each."""
    if bits * substrings <= sample.shape[1]:
        return learn(sample, bits * substrings)
    each = [learn(sample, bits, seed=42 + i) for i in range(substrings)]
    return each[0][0], np.hstack([r for _, r in each])


def bits_for(n: int, width: int) -> int:
    """Bits of a substring: few records a bucket, however many there are."""
    n = max(n, 10)
    return int(min(width, max(4, round(5 + math.log10(n)), round(math.log2(n) - 9))))


def codes_of(x: np.ndarray, centre: np.ndarray, rotation: np.ndarray, substrings: int = SUBSTRINGS) -> list[np.ndarray]:
    """The substrings of the codes."""
    on = (x - centre) @ rotation > 0
    half = rotation.shape[1] // substrings
    weight = 1 << np.arange(half)
    return [on[:, i * half : (i + 1) * half] @ weight for i in range(substrings)]


def _vectors(b: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(first, b.num_columns)]) + 0.0


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * x.shape[1]), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


ENTRY = "lane bigint, id bigint, bucket int, spare int, vector binary"


def _entries(lane, ids, bucket, spare, vector) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lane), pa.array(ids), pa.array(bucket.astype(np.int32)), pa.array(np.full(len(ids), spare, np.int32)), vector], names=["lane", "id", "bucket", "spare", "vector"])


def _index(centre: np.ndarray, rotation: np.ndarray, substrings: int, group_bits: int, salts: int):
    """The index entries of every vector, one per substring."""
    half = rotation.shape[1] // substrings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), _vectors(b, 1)
            ok = ~np.isnan(x).any(1)
            ids, x = ids[ok], x[ok]
            vector = _binary(x - centre)
            for side, code in enumerate(codes_of(x, centre, rotation, substrings)):
                lane = ((side << group_bits) + (code >> (half - group_bits))) * salts + (ids * 2654435761 >> 7) % salts
                yield _entries(lane, ids, code, 0, vector)

    return run


def _probe(centre: np.ndarray, rotation: np.ndarray, substrings: int, group_bits: int, salts: int):
    """A query once per lane that it probes: those up to RADIUS high bits away.

    ``spare`` is the number of low bits that may still differ in that lane.
    """
    half = rotation.shape[1] // substrings
    flips = [sum(1 << g for g in c) for r in range(RADIUS + 1) for c in combinations(range(group_bits), r)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), _vectors(b, 1)
            ok = ~np.isnan(x).any(1)
            ids, x = ids[ok], x[ok]
            vector = _binary(x - centre)
            for side, code in enumerate(codes_of(x, centre, rotation, substrings)):
                for flip in flips:
                    near = code ^ (flip << (half - group_bits))
                    for salt in range(salts):
                        lane = ((side << group_bits) + (near >> (half - group_bits))) * salts + salt
                        yield _entries(lane, ids, near, RADIUS - flip.bit_count(), vector)

    return run


def without_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Positions of all rows but those that have k + 1 copies under smaller ids.

    No answer can contain such a row, as ties go to the smaller id.
    """
    _, group = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return np.sort(order[place <= k])


def nearest(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` among which are each query's k nearest others: (query, row, squared distance).

    With ``limit``, all others within these squared distances instead.
    """
    out = ([], [], [])
    if limit is None and len(ids) > LARGE_BUCKET:
        kept = without_copies(ids, x, k)
        ids, x = ids[kept], x[kept]
    if len(ids) > LARGE_BUCKET:
        return _by_rings(qid, q, ids, x, k, limit)
    xx = (x * x).sum(1)
    # Squared distances in one product: [-2q, |q|^2, 1] times [x, 1, |x|^2].
    right = np.ascontiguousarray(np.column_stack([x, np.ones_like(xx), xx]).T)
    m = k + 4
    for i in range(0, len(q), 256):
        p = q[i : i + 256]
        pp = (p * p).sum(1)
        d = np.column_stack([-2 * p, pp, np.ones_like(pp)]) @ right
        slack = (1e-5 + 4e-6 * (pp + xx.max())).astype(d.dtype)
        if limit is not None:
            edge = limit[i : i + 256] + slack
        elif len(ids) > m:
            edge = np.partition(d, m - 1, axis=1)[:, m - 1] + slack
        else:
            edge = np.full(len(p), np.inf)
        u, v = np.divmod(np.flatnonzero((d <= edge[:, None].astype(d.dtype)).ravel()), len(ids))
        exact = ((p[u].astype(np.float64) - x[v]) ** 2).sum(1)
        other = ids[v] != qid[i + u]
        out[0].append(i + u[other])
        out[1].append(ids[v[other]])
        out[2].append(exact[other])
    q_, i_, d_ = (np.concatenate(o) for o in out)
    return q_, i_, d_


def _by_rings(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, limit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`nearest` for many rows, in the order of their distance from the rows' centre.

    By the triangle inequality only a ring of rows, as wide as the k-th distance,
    can hold the nearest; that distance is bounded by the rows next in order.
    """
    centre = x.mean(0, dtype=np.float64)
    far, ask = (np.sqrt(((v - centre) ** 2).sum(1)) for v in (x, q))
    order, turn = np.argsort(far, kind="stable"), np.argsort(ask, kind="stable")
    ids, x, far = ids[order], x[order], far[order]
    out = ([], [], [])
    for i in range(0, len(q), 64):
        w = turn[i : i + 64]
        p, at = q[w], ask[w]
        if limit is None:
            a, b = np.searchsorted(far, [at[0], at[-1]])
            a, b = max(0, min(a, len(far) - 1) - 256), min(len(far), b + 256)
            d = ((p[:, None].astype(np.float64) - x[None, a:b]) ** 2).sum(2) if b - a <= 2048 else (p.astype(np.float64) ** 2).sum(1)[:, None] + (x[a:b].astype(np.float64) ** 2).sum(1)[None] - 2.0 * (p.astype(np.float64) @ x[a:b].T.astype(np.float64))
            bound = np.partition(np.maximum(d, 0), min(k, b - a - 1), axis=1)[:, min(k, b - a - 1)]
        else:
            bound = limit[w]
        ring = np.sqrt(np.minimum(bound, 1e300)) * (1 + 1e-6) + 1e-5
        a, b = np.searchsorted(far, (at - ring).min()), np.searchsorted(far, (at + ring).max(), "right")
        for s in range(a, b, LARGE_BUCKET):
            e = min(s + LARGE_BUCKET, b)
            c, j, d = nearest(qid[w], p, ids[s:e], x[s:e], k, bound)
            for held, part in zip(out, (w[c], j, d)):
                held.append(part)
    return tuple(np.concatenate(o) for o in out) if out[0] else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))


def best(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k smallest distances, ties by id, each id once."""
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    if len(q):
        once = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]
        q, ids, d = q[once], ids[once], d[once]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, ids, d = q[place < k], ids[place < k], d[place < k]
    return q, ids, d


FOUND = "query bigint, id bigint, d2 double"


def _search(half: int, group_bits: int, width: int, k: int):
    """One lane: its index entries and the queries that probe it."""
    empty = pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "d2": pa.array([], pa.float64())})
    low_bits = half - group_bits
    flips = {s: np.array([sum(1 << g for g in c) for r in range(1, s + 1) for c in combinations(range(low_bits), r)], np.int64) for s in range(RADIUS + 1)}

    def unpack(t: pa.Table):
        # Vectors have one width, so their bytes lie next to each other.
        v = t.column("vector").combine_chunks()
        x = np.frombuffer(v.buffers()[2], np.float32)[np.frombuffer(v.buffers()[1], np.int32)[v.offset] // 4 :][: len(v) * width].reshape(-1, width)
        return t.column("id").to_numpy(), t.column("bucket").to_numpy().astype(np.int64), x

    def run(index: pa.Table, probes: pa.Table) -> pa.Table:
        if not len(index) or not len(probes):
            return empty
        ids, bucket, x = unpack(index)
        if np.bincount(bucket & ((1 << low_bits) - 1)).max() > LARGE_BUCKET:
            kept = without_copies(ids, x, k)
            ids, bucket, x = ids[kept], bucket[kept], x[kept]
        order = np.lexsort((ids, bucket))
        ids, bucket, x = ids[order], bucket[order], np.ascontiguousarray(x[order])
        qid, code, q = unpack(probes)
        spare = probes.column("spare").to_numpy()
        present, starts = np.unique(bucket, return_index=True)
        ends = np.r_[starts[1:], len(bucket)]
        limit = np.full(len(qid), np.inf)
        got = ([], [], [])

        def visit(who: np.ndarray, where: np.ndarray, limited: bool) -> None:
            order = np.argsort(where, kind="stable")
            who, where = who[order], where[order]
            a, b = np.searchsorted(where, present), np.searchsorted(where, present, "right")
            new = ([], [], [])
            for s, e, f, t in zip(starts, ends, a, b):
                if f < t:
                    w = who[f:t]
                    at, i, d = nearest(qid[w], q[w], ids[s:e], x[s:e], k, limit[w] if limited else None)
                    for held, part in zip(new, (w[at], i, d)):
                        held.append(part)
            if new[0]:
                w, i, d = best(*(np.concatenate(h) for h in new), k)
                for held, part in zip(got, (w, i, d)):
                    held.append(part)
                if not limited and len(w):
                    last = np.r_[w[1:] != w[:-1], True]
                    full = np.bincount(w, minlength=len(qid))[w[last]] == k
                    limit[w[last][full]] = d[last][full]

        # The own bucket first: its k-th distance limits what the others must give.
        visit(np.arange(len(qid)), code, False)
        for s, f in flips.items():
            at = np.flatnonzero(spare == s)
            if len(f) and len(at):
                visit(np.repeat(at, len(f)), (code[at][:, None] ^ f[None]).ravel(), True)
        if not got[0]:
            return empty
        w, i, d = best(*(np.concatenate(g) for g in got), k)
        return pa.table({"query": pa.array(qid[w.astype(int)]), "id": pa.array(i.astype(np.int64)), "d2": pa.array(d.astype(float))})

    return run


def _scan(qid: np.ndarray, q: np.ndarray, centre: np.ndarray, k: int):
    """All rows against a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = tuple(np.zeros(0) for _ in range(3))
        for b in batches:
            ids, x = b.column(0).to_numpy(), _vectors(b, 1)
            ok = ~np.isnan(x).any(1)
            if ok.any():
                new = nearest(qid, q, ids[ok], x[ok] - centre, k)
                got = best(*(np.concatenate(p) for p in zip(got, new)), k)
        yield pa.RecordBatch.from_arrays([pa.array(qid[got[0].astype(int)]), pa.array(got[1].astype(np.int64)), pa.array(got[2])], names=["query", "id", "d2"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """At most k rows per query from the few that the lanes found."""
    each = found.groupBy("query", "id").agg(F.min("d2").alias("d2")).groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "id"))), 1, k).alias("near"))
    place = each.select("query", F.posexplode("near").alias("place", "n"))
    return place.select("query", (F.col("place") + 1).alias("place"), F.col("n.id").alias("id"), F.sqrt("n.d2").alias("distance"))


def exact(vectors: DataFrame, queries: DataFrame, features: Sequence[str], k: int, centre: np.ndarray | None = None) -> DataFrame | None:
    """The k nearest others by comparing queries with all vectors, in blocks of queries; None without queries.

    Result and handling of nulls as :func:`similar`.
    """
    asked = queries.select("id", *features)
    blocks, out = math.ceil(asked.count() / BLOCK), None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas().dropna()
        if len(part):
            q = part[list(features)].to_numpy(dtype=float)
            middle = q.mean(0) if centre is None else centre
            scan = vectors.select("id", *features).mapInArrow(_scan(part["id"].to_numpy(), q - middle, middle, k), FOUND)
            out = scan if out is None else out.unionByName(scan)
    return None if out is None else _top(out, k)


def similar(vectors: DataFrame, queries: DataFrame, features: Sequence[str], k: int = 5, substrings: int = SUBSTRINGS) -> DataFrame:
    """The k most similar other vectors of each query: (query, place, id, distance).

    ``vectors`` has a unique BIGINT ``id`` and the ``features``; ``queries`` has
    the same columns (repeated ids count once). Rows with a null or NaN feature
    are neither found nor answered. Ties go to the smaller id; a vector is never
    its own neighbour, but exact copies under other ids are. Queries whose
    buckets hold fewer than k others are answered exactly, in blocks against all
    vectors; so a query gets fewer than k rows only if there are fewer. An empty
    table gives no rows.
    """
    if substrings < 1:
        raise ValueError("at least one substring")
    n = vectors.count()
    all_, asked = vectors.select("id", *features), queries.select("id", *features).dropDuplicates(["id"])
    half = bits_for(n, len(features))
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(n, 1))
    sample = all_.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share)).select(*features).limit(SAMPLE_ROWS).toPandas().dropna().to_numpy(dtype=float)
    centre, rotation = rotations(sample if len(sample) else np.zeros((1, len(features))), half, substrings)
    group_bits = int(min(half - 1, max(2, math.ceil(math.log2(max(n, 1) / TASK_ROWS)))))
    # The largest lane of the sample tells into how many parts lanes are salted.
    lanes = [np.bincount(c >> (half - group_bits), minlength=1 << group_bits).max() / max(len(sample), 1) for c in codes_of(sample, centre, rotation, substrings)] if len(sample) else [0]
    salts = max(1, math.ceil(max(lanes) * n / (4 * TASK_ROWS)))
    index = all_.mapInArrow(_index(centre, rotation, substrings, group_bits, salts), ENTRY)
    probes = asked.mapInArrow(_probe(centre, rotation, substrings, group_bits, salts), ENTRY)
    found = index.groupBy("lane").cogroup(probes.groupBy("lane")).applyInArrow(_search(half, group_bits, len(features), k), FOUND)
    first = materialize(_top(found, k), "found")
    enough = first.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query").alias("id"))
    rest = materialize(asked.dropna().join(enough, "id", "left_anti"), "rest")
    late = exact(all_, rest, features, k, centre)
    if late is None:
        return first
    return first.join(rest.select(F.col("id").alias("query")), "query", "left_anti").unionByName(late)
