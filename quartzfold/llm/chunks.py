"""Same and near-same records across splits, by content-defined chunks.

A record is normalised to a sequence of cells, one per field (``floor(v /
width)``). A rolling hash over neighbouring cells cuts the sequence into chunks;
every ``frame`` fields a cut is forced, as the longest chunk allowed. Chunks are
digested together with the coarse blocks of the near-equal fields (time,
amount), and digests are joined across splits. The lengths of the shared chunks
add up to the overlap fraction of a pair.

Nothing within the tolerance is lost: a value within ``tolerance`` of a cell's
edge may have a partner in the next cell, so the evaluated side also emits the
chunks of that other cell. With at most d differing fields, all frames but d
agree in every chunk of one of these variants; with more frames than d a pair
therefore shares at least ``fields - d * frame`` fields.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfold.session import materialize

#: Cell of a null field.
NULL_CELL = -32768
#: A cut after one in so many fields, on average.
CUT = 8
#: Up to so many candidate records are broadcast for the exact check.
BROADCAST_RECORDS = 500_000
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def cells_of(values: np.ndarray, width: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells, and -1, 0 or 1: the side on which another cell is within the tolerance."""
    null = np.isnan(values)
    scaled = np.where(null, 0, values) / width
    cell = np.floor(scaled)
    at = (scaled - cell) * width
    side = np.where(at <= tolerance, -1, np.where(width - at <= tolerance, 1, 0))
    cell = np.clip(cell, NULL_CELL + 2, 32765)
    return np.where(null, NULL_CELL, cell).astype(np.int16), np.where(null, 0, side).astype(np.int8)


def chunks_of(cells: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of one frame for many records: (record, digest, length)."""
    n, k = cells.shape
    token = mix64(cells.astype(np.int64).view(np.uint64) + _BASE * np.arange(first + 1, first + k + 1, dtype=np.uint64))
    rolling = token.copy()
    rolling[:, 1:] = token[:, 1:] * np.uint64(31) + token[:, :-1]
    cut = (rolling >> np.uint64(40)) % np.uint64(CUT) == 0
    cut[:, -1] = True
    digest, length = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    records, digests, lengths = [], [], []
    for j in range(k):
        digest = digest * _BASE + token[:, j]
        length += 1
        at = np.flatnonzero(cut[:, j])
        records.append(at)
        digests.append(mix64(digest[at] + np.uint64(first + j)))
        lengths.append(length[at])
        digest[at], length[at] = 0, 0
    return np.concatenate(records), np.concatenate(digests), np.concatenate(lengths)


def variants_of(cells: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All cells within the tolerance: (record, cells), the record's own first."""
    record = np.arange(len(cells))
    own = sides
    for j in range(cells.shape[1]):
        at = np.flatnonzero(own[:, j])
        if len(at):
            other = cells[at].copy()
            other[:, j] += own[at, j]
            cells, own, record = np.concatenate([cells, other]), np.concatenate([own, own[at]]), np.concatenate([record, record[at]])
    return record, cells


def _normalise(fields: int, width: float, tolerance: float, coarse: Sequence[tuple[float, float]]):
    """(row_id, fields.., near.., ) to (row_id, near cells and sides, cells and sides)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            get = lambda i: b.column(i).to_numpy(zero_copy_only=False).astype(float)
            cells, sides = cells_of(np.column_stack([get(1 + i) for i in range(fields)]), width, tolerance)
            near = [get(1 + fields + i) for i in range(len(coarse))]
            near_cells = np.column_stack([np.floor(x / w) for x, (w, _) in zip(near, coarse)]).astype(np.int64)
            near_sides = np.column_stack([np.where(x - np.floor(x / w) * w <= t, -1, np.where(w - (x - np.floor(x / w) * w) <= t, 1, 0)) for x, (w, t) in zip(near, coarse)]).astype(np.int8)
            packed = np.hstack([near_cells.view(np.int8).reshape(len(cells), -1), near_sides, cells.view(np.int8).reshape(len(cells), -1), sides])
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))])
            yield pa.RecordBatch.from_arrays([b.column(0), data.cast(pa.binary())], names=["row_id", "record"])

    return run


def _chunked(fields: int, frame: int, near: int):
    """(split, train, row_id, record) to (digest, split, train, row_id, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            raw = np.frombuffer(b.column("record").cast(pa.binary()).buffers()[2], np.uint8)
            ends = np.frombuffer(b.column("record").buffers()[1], np.int32)[b.column("record").offset :][: n + 1]
            raw = raw[ends[0] : ends[n]].reshape(n, -1)
            part = np.split(raw, np.cumsum([8 * near, near, 2 * fields]), axis=1)
            near_cells, near_sides, cells, sides = (np.ascontiguousarray(x).view(t) for x, t in zip(part, (np.int64, np.int8, np.int16, np.int8)))
            split, train, row = b.column("split").to_numpy(), b.column("train").to_numpy(zero_copy_only=False).astype(bool), b.column("row_id").to_numpy()
            for own in (True, False):
                at = np.flatnonzero(train == own)
                if not len(at):
                    continue
                if own:
                    block_of, blocks = np.arange(len(at)), near_cells[at]
                else:
                    block_of, blocks = variants_of(near_cells[at], near_sides[at])
                block = mix64(split[at][block_of].view(np.uint64))
                for j in range(near):
                    block = mix64(block * np.uint64(31) + blocks[:, j].view(np.uint64))
                order = np.argsort(block_of, kind="stable")
                block, times = block[order], np.bincount(block_of, minlength=len(at))
                starts = np.r_[0, np.cumsum(times)[:-1]]
                for first in range(0, fields, frame):
                    c, s = cells[at, first : first + frame], sides[at, first : first + frame]
                    record, c = (np.arange(len(at)), c) if own else variants_of(c, s)
                    r, digest, length = chunks_of(c, first)
                    r = record[r]
                    if not own:
                        _, once = np.unique(np.rec.fromarrays([r, digest]), return_index=True)
                        r, digest, length = r[once], digest[once], length[once]
                    rep = np.repeat(np.arange(len(r)), times[r])
                    k = np.arange(len(rep)) - np.repeat(np.cumsum(times[r]) - times[r], times[r])
                    key = mix64(digest[rep] ^ block[starts[r[rep]] + k])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(split[at][r[rep]]), pa.array(np.full(len(rep), own)), pa.array(row[at][r[rep]]), pa.array(length[rep].astype(np.int32))], names=["digest", "split", "train", "row_id", "length"])

    return run


def candidates(records: DataFrame, splits: DataFrame, fields: Sequence[str], near: dict[str, tuple[float, float]], width: float = 0.25, tolerance: float = 0.01, frame: int = 7, least: float = 0.5) -> DataFrame:
    """Pairs of a split sharing at least ``least`` of their fields in chunks: (split, train_id, eval_id, overlap).

    ``records`` has row_id, the ``fields`` and the ``near`` columns, each with
    its block width and tolerance; ``splits`` has split (BIGINT: records are
    only compared within one), train (BOOLEAN) and row_id.
    """
    names = list(near)
    known = F.lit(True)
    for c in names:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    ready = records.where(known & F.col("row_id").isNotNull()).select("row_id", *fields, *names)
    normal = ready.mapInArrow(_normalise(len(fields), width, tolerance + 1e-9, [(w, t + 1e-9) for w, t in near.values()]), "row_id bigint, record binary")
    placed = splits.join(normal, "row_id").select("split", "train", "row_id", "record")
    chunk = materialize(placed.mapInArrow(_chunked(len(fields), frame, len(names)), "digest bigint, split bigint, train boolean, row_id bigint, length int"), "chunks")
    a = chunk.where("train").select("digest", "split", F.col("row_id").alias("train_id"), "length")
    b = chunk.where("not train").select("digest", "split", F.col("row_id").alias("eval_id"), F.col("length").alias("length_b"))
    shared = a.join(b, ["digest", "split"]).where("length = length_b").groupBy("split", "train_id", "eval_id").agg((F.sum("length") / len(fields)).alias("overlap"))
    return shared.where(F.col("overlap") >= least)


def differs(a: Column, b: Column, tolerance: float) -> Column:
    """1 if two values differ by more than the tolerance; null against a value does, two nulls do not."""
    none = (a.isNull() & b.isNull()) | (F.abs(a - b) <= tolerance + 1e-9)
    return F.when(none, 0).otherwise(1)


def overlaps(records: DataFrame, splits: DataFrame, fields: Sequence[str], near: dict[str, tuple[float, float]], tolerance: float = 0.01, different: int = 2, **how) -> DataFrame:
    """All pairs of a training and an evaluated record of one split that are (almost) the same.

    A pair has all ``near`` columns within their tolerance (a null or NaN rules
    it out) and at most ``different`` of the ``fields`` differing by more than
    ``tolerance`` (NaN is null; null against a value differs, two nulls do not).
    Candidates come from shared chunks; the check of the values is exact.
    Repeated rows of ``splits`` count once. Returns (split, train_id, eval_id,
    overlap); empty inputs give no rows.
    """
    frame = how.setdefault("frame", 7)
    how.setdefault("least", max(0.0, (len(fields) - different * frame) / len(fields)) - 1e-9)
    if how["least"] <= 0:
        raise ValueError("more frames than differing fields are needed")
    splits = splits.select("split", "train", "row_id").distinct()
    pairs = materialize(candidates(records, splits, fields, near, tolerance=tolerance, **how), "candidates")
    few = pairs.count() <= BROADCAST_RECORDS
    small = F.broadcast if few else (lambda df: df)
    ids = pairs.select(F.explode(F.array("train_id", "eval_id")).alias("row_id")).distinct()
    number = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")).alias(c)
    rows = records.select("row_id", *[number(c) for c in [*fields, *near]]).join(small(ids), "row_id", "left_semi")
    rows = materialize(rows.select("row_id", F.struct(*fields, *near).alias("r")), "checked")
    x = pairs.join(rows.select(F.col("row_id").alias("train_id"), F.col("r").alias("a")), "train_id").join(rows.select(F.col("row_id").alias("eval_id"), F.col("r").alias("b")), "eval_id")
    close = F.lit(True)
    for c, (_, t) in near.items():
        close = close & (F.abs(F.col("a")[c] - F.col("b")[c]) <= t + 1e-9)
    count = sum((differs(F.col("a")[c], F.col("b")[c], tolerance) for c in fields), F.lit(0))
    found = x.where(close).where(count <= different).select("split", "train_id", "eval_id", "overlap")
    return found
