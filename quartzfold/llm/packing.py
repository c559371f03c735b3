"""Filling containers of fixed capacity, best fit in bulk-synchronous steps.

Documents longer than half the capacity, and full pieces of those beyond it,
open a container each. The others are placed in rounds. In a round documents and
gaps are sorted by size into ranges, a gap going to the range of its successor
downwards, the largest document that it holds. Every range is swept at once, in
ascending order of its gaps: a gap takes the largest document left that fits,
and again, until none does; where several gaps want a document, the one that
comes first in this order gets it. Gaps are updated, those that hold no document
any more leave, and the next round ranges what is left anew. As long as the gaps
cannot hold all documents, empty containers are added, as many as their tokens
need at least.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzfold.session import materialize

#: Documents and gaps that one sweep should hold.
TASK_ROWS = 50_000
#: Ranges of sizes; larger ones are swept in several parts.
RANGES = 32
#: Documents of a lane in which containers are numbered, and the fewest lanes.
LANE_ROWS, LEAST_LANES = 100_000, 64

STATE = "id bigint, piece int, token_from bigint, tokens bigint, container_id bigint, gap bigint"


def fill(sizes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """One sweep: for every document (ascending sizes) its gap's position, or -1; the gaps ascend too."""
    present, first = np.unique(sizes, return_index=True)
    held = present.tolist()
    # Documents of a size are taken from the last to the first.
    next_ = dict(zip(held, (np.r_[first[1:], len(sizes)] - 1).tolist()))
    last = dict(zip(held, first.tolist()))
    out = [-1] * len(sizes)
    for g, room in enumerate(gaps.tolist()):
        at = bisect.bisect_right(held, room) - 1
        while at >= 0:
            size = held[at]
            d = next_[size]
            out[d] = g
            if d == last[size]:
                del held[at]
            else:
                next_[size] = d - 1
            room -= size
            # What fits now is at most as long as what was just taken.
            at = bisect.bisect_right(held, room, 0, min(at + 1, len(held))) - 1
        if not held:
            break
    return np.array(out, np.int64)


def _sweep(t: pa.Table) -> pa.Table:
    """A range: rows with ``id`` are documents, the others gaps."""
    t = t.select([c.split()[0] for c in STATE.split(", ")])
    t = t.sort_by([("tokens", "ascending"), ("gap", "ascending"), ("id", "ascending"), ("piece", "ascending"), ("container_id", "ascending")])
    is_document = t.column("id").is_valid()
    documents, gaps = t.filter(is_document), t.filter(pa.compute.invert(is_document))
    size, gap = documents.column("tokens").to_numpy(), gaps.column("gap").to_numpy().copy()
    got = fill(size, gap)
    placed = got >= 0
    np.subtract.at(gap, got[placed], size[placed])
    container = np.where(placed, gaps.column("container_id").to_numpy()[got], 0) if len(gap) else np.zeros(len(size), np.int64)
    documents = documents.set_column(4, "container_id", pa.array(container, pa.int64(), mask=~placed))
    return pa.concat_tables([documents, gaps.set_column(5, "gap", pa.array(gap, pa.int64()))])


def _numbered(openers: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``first``, the number of a row's first container of ``opened``; also the number of all."""
    lanes = max(LEAST_LANES, math.ceil(openers.count() / LANE_ROWS))
    laned = openers.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)))
    totals = materialize(laned.groupBy("lane").agg(F.sum("opened").alias("t")), "lanes")
    # One row per lane.
    before = Window.partitionBy(F.lit(0)).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("lane", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("lane").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = laned.withColumn("own", F.coalesce(F.sum("opened").over(own), F.lit(0))).join(offsets, "lane")
    return ranked.withColumn("first", F.col("own") + F.col("offset")).drop("lane", "own", "offset"), int(totals.agg(F.sum("t")).first()[0] or 0)


def _ranges(documents: dict[int, int], gaps: dict[int, int], task_rows: int) -> list[tuple[int, int]]:
    """Lower bounds of the ranges and the parts of each, from the numbers of documents and gaps by size."""
    sizes = sorted(documents)
    total = sum(documents.values())
    each = total / min(RANGES, max(1, math.ceil(total / task_rows)))
    bounds, held = [sizes[0]], 0
    for s in sizes:
        if held >= each:
            bounds.append(s)
            held = 0
        held += documents[s]
    rows = [0] * len(bounds)
    for s, n in [*documents.items(), *gaps.items()]:
        rows[bisect.bisect_right(bounds, s) - 1] += n
    return [(b, max(1, round(n / task_rows))) for b, n in zip(bounds, rows)]


def place(documents: DataFrame, gaps: DataFrame, made: int, capacity: int, task_rows: int) -> list[DataFrame]:
    """Rounds until every document has a container; the placed documents of each round.

    ``documents`` and ``gaps`` have the columns of ``STATE``. The driver sees how
    many there are of each size only: at most ``capacity`` numbers of each.
    """
    spark, out, turn = documents.sparkSession, [], 0
    state = materialize(documents.unionByName(gaps), "state")
    while True:
        counts = state.where("id is null or container_id is null").groupBy(F.col("id").isNull().alias("is_gap"), F.coalesce("gap", "tokens").alias("size")).count().collect()
        wanted = {int(r["size"]): int(r["count"]) for r in counts if not r["is_gap"]}
        if not wanted:
            return out
        least = min(wanted)
        open_ = {int(r["size"]): int(r["count"]) for r in counts if r["is_gap"] and r["size"] >= least}
        room = lambda d: sum(s * n for s, n in d.items())
        # Empty containers for what the gaps cannot hold; one at least if nothing fitted in the last round.
        more = max(0, math.ceil((room(wanted) - room(open_)) / capacity), 0 if open_ else 1)
        left = state.where(F.when(F.col("id").isNull(), F.col("gap") >= least).otherwise(F.col("container_id").isNull()))
        if turn and sum(wanted.values()) == before:
            more = max(more, 1)
        before = sum(wanted.values())
        if more:
            new = spark.range(made, made + more).select(*[F.lit(None).cast(t).alias(c) for c, t in (("id", "bigint"), ("piece", "int"), ("token_from", "bigint"), ("tokens", "bigint"))], F.col("id").alias("container_id"), F.lit(capacity).cast("bigint").alias("gap"))
            left, made = left.unionByName(new), made + more
            open_[capacity] = open_.get(capacity, 0) + more
        ranges = _ranges(wanted, open_, task_rows)
        size = F.coalesce("gap", "tokens")
        at = F.lit(0)
        for i, (bound, _) in enumerate(ranges[1:], 1):
            at = F.when(size >= bound, F.lit(i)).otherwise(at)
        parts = F.element_at(F.array(*[F.lit(n) for _, n in ranges]), at + 1)
        spread = F.pmod(F.xxhash64(F.lit(turn), F.coalesce("id", "container_id"), F.coalesce("piece", F.lit(-1))), parts)
        swept = left.withColumn("range", at).withColumn("part", spread).groupBy("range", "part").applyInArrow(_sweep, STATE)
        new = materialize(swept, "state")
        out.append(new.where("id is not null and container_id is not null").drop("gap"))
        state, turn = new, turn + 1


def pack(sizes: DataFrame, capacity: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """Containers for all documents: (container_id, id, piece, token_from, tokens).

    ``sizes`` has a unique ``id`` and ``tokens``. A document is one piece unless
    it exceeds the capacity; then it is cut into full pieces and a rest. No
    container holds more than ``capacity``. Documents without tokens (null
    counts as none) need no room: one row with tokens 0 and no container. An
    empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    full, rest = F.floor(F.col("all") / capacity), F.col("all") % capacity
    large = (rest * 2 > capacity).cast("bigint")
    sizes = sizes.select("id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("all"))
    sizes = materialize(sizes.withColumns({"pieces": full, "rest": rest, "opened": full + large}), "sizes")
    openers, made = _numbered(sizes.where("opened > 0"))
    opened = materialize(openers, "opened")
    piece = F.explode(F.sequence(F.lit(0), F.col("opened").cast("int") - 1)).alias("piece")
    own = opened.select("id", "pieces", "rest", "first", piece)
    own = own.select("id", "piece", (F.col("piece").cast("bigint") * capacity).alias("token_from"), F.when(F.col("piece") < F.col("pieces"), capacity).otherwise(F.col("rest")).cast("bigint").alias("tokens"), (F.col("first") + F.col("piece")).alias("container_id"))
    nothing = lambda *columns: [F.lit(None).cast(t).alias(c) for c, t in columns]
    gaps = opened.where("opened > pieces and rest < %d" % capacity).select(*nothing(("id", "bigint"), ("piece", "int"), ("token_from", "bigint"), ("tokens", "bigint")), (F.col("first") + F.col("pieces")).alias("container_id"), (F.lit(capacity) - F.col("rest")).cast("bigint").alias("gap"))
    small = sizes.where("rest > 0 and opened = pieces").select("id", F.col("pieces").cast("int").alias("piece"), (F.col("pieces") * capacity).alias("token_from"), F.col("rest").alias("tokens"), *nothing(("container_id", "bigint"), ("gap", "bigint")))
    none = sizes.where("all = 0").select("id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("token_from"), F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("bigint").alias("container_id"))
    out = own.unionByName(none)
    for placed in place(small, gaps, made, capacity, task_rows):
        out = out.unionByName(placed)
    return out
