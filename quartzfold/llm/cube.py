"""Samples with wanted category shares, by the cube method.

The balancing variables are the category indicators, so the kernel of the
constraints is spanned by the differences of two records of one category: a
flight step moves two undecided records along such a difference until one of
them is decided. All pairs of a batch move at once, then the pairs of those left
over, until a category has one undecided record. Each partition flies over its
own records and is left with at most one per request and category; these few are
merged and fly on, and the landing decides what is left then.

Probabilities are fractions mass / full of whole numbers (need / supply at the
start), so no rounding is involved: the masses of a category add up to need x
full, and exactly ``need`` records end with full mass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfold.session import materialize

UNITS = "request_id bigint, category int, row_id bigint, mass bigint, full bigint, u double"
#: Partitions whose undecided records are merged in one step.
FAN_IN = 64
#: Undecided records that a partition carries from batch to batch.
CARRY = 200_000


def digest(columns: Sequence[str]) -> list[Column]:
    """128 bits that tell distinct rows apart; two nulls are equal, 0 and -0 too."""
    values = []
    for c in columns:
        values += [F.coalesce(F.col(c).cast("double") + F.lit(0.0), F.lit(0.0)), F.col(c).isNull()]
    return [F.xxhash64(*values).alias("digest_a"), F.xxhash64(F.lit(7919), *reversed(values)).alias("digest_b")]


def distinct_pool(rows: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Per batch and category one record, the smallest ``row_id``, of each group of identical ones."""
    slim = rows.where("batch_id is not null and category is not null").select("batch_id", "category", "row_id", *digest(identity))
    return slim.groupBy("batch_id", "category", "digest_a", "digest_b").agg(F.min("row_id").alias("row_id")).select("batch_id", "category", "row_id")


def fly(group: np.ndarray, mass: np.ndarray, full: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Flight over records in the order of their groups; changes ``mass`` and ``u``, returns the positions of the undecided.

    A step takes the random number of the first of a pair; the one that stays
    undecided goes on with the number of the second.
    """
    at = np.flatnonzero((mass > 0) & (mass < full))
    while True:
        # The even places of a group's undecided records, each with its successor.
        g = group[at]
        place = np.arange(len(at)) - np.searchsorted(g, g)
        first = np.flatnonzero((place[:-1] % 2 == 0) & (g[:-1] == g[1:])) if len(at) > 1 else np.zeros(0, int)
        if not len(first):
            return at
        i, j = at[first], at[first + 1]
        p, q, f = mass[i], mass[j], full[i]
        s, draw = p + q, u[i].copy()
        over = s >= f
        # Below full mass one takes both masses, else one is filled and the other keeps the rest.
        keeps = np.where(over, draw * (2.0 * f - s) < f - q, draw * s < p)
        high, low = np.where(over, f, s), np.where(over, s - f, 0)
        mass[i], mass[j] = np.where(keeps, high, low), np.where(keeps, low, high)
        u[i] = u[j]
        at = at[(mass[at] > 0) & (mass[at] < full[at])]


def flight(landing: bool):
    """Flight over the records of a partition; with ``landing`` the last undecided ones are decided too."""

    def out(request, category, row, mass, full, u) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((request, category, row, mass, full, u), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["request_id", "category", "row_id", "mass", "full", "u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, np.int64, np.float64)]
        for b in batches:
            x = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
            # Low digits of the random number give a random order that says nothing about the number.
            order = np.lexsort((x[5] * 2.0**20 % 1.0, x[1], x[0]))
            request, category, row, mass, full, u = (v[order] for v in x)
            new = np.r_[True, (request[1:] != request[:-1]) | (category[1:] != category[:-1])][: len(request)]
            open_ = fly(np.cumsum(new), mass, full, u)
            done = np.flatnonzero(mass >= full)
            yield out(request[done], category[done], row[done], full[done], full[done], u[done])
            held = [v[open_] for v in (request, category, row, mass, full, u)]
            if len(open_) > CARRY and not landing:
                yield out(*held)
                held = [v[:0] for v in held]
        if landing:
            held[3] = np.where(held[5] * held[4] < held[3], held[4], 0)
            held = [v[held[3] > 0] for v in held]
        yield out(*held)

    return run


def draw(rows: DataFrame, requests: DataFrame, identity: Sequence[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Samples for many requests, and the report on them.

    ``rows`` has batch_id, category, row_id and the ``identity`` columns;
    ``requests`` has request_id, batch_id, sample_size, category, target_share
    and min_rows, a row per request and category. Rows without batch or category
    serve nothing. The need of a request's category is the larger of min_rows
    and the rounded target_share * sample_size (null counts as 0); its supply is
    the number of distinct records. Where supply is short all of it is drawn.

    Returns (request_id, category, row_id) and (request_id, category, need,
    supply, drawn, target_share, share): every request and category has a row,
    share is null for an empty sample. Empty inputs give empty results.
    """
    pool = materialize(distinct_pool(rows, identity), "pool")
    supply = pool.groupBy("batch_id", "category").agg(F.count("*").alias("supply"))
    wanted = F.round(F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0))).cast("bigint")
    needs = requests.select("request_id", "batch_id", F.col("category").cast("int").alias("category"), "target_share", F.greatest(F.coalesce("min_rows", F.lit(0)).cast("bigint"), wanted).alias("need"))
    needs = materialize(needs.join(supply, ["batch_id", "category"], "left").withColumn("supply", F.coalesce("supply", F.lit(0).cast("bigint"))), "needs")
    target = needs.where("need > 0 and supply > 0").select("request_id", "batch_id", "category", F.least("need", "supply").alias("mass"), F.col("supply").alias("full"))
    u = F.shiftrightunsigned(F.xxhash64("row_id", F.lit(seed + 1), "request_id"), 11) / F.lit(float(2**53))
    columns = ["request_id", "category", "row_id", "mass", "full", "u"]
    units = pool.join(target, ["batch_id", "category"]).withColumn("u", u).select(*columns)
    flown = materialize(units.mapInArrow(flight(False), UNITS), "flown")
    decided, open_ = flown.where("mass = full"), flown.where("mass < full")
    landed = open_.withColumn("lane", F.pmod(F.xxhash64("row_id"), F.lit(FAN_IN))).repartition("request_id", "category", "lane").select(*columns).mapInArrow(flight(False), UNITS)
    landed = landed.repartition("request_id", "category").mapInArrow(flight(True), UNITS)
    sample = materialize(decided.unionByName(landed).select("request_id", "category", "row_id"), "sample")
    drawn = sample.groupBy("request_id", "category").agg(F.count("*").alias("drawn"))
    report = needs.join(drawn, ["request_id", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("bigint")))
    total = report.groupBy("request_id").agg(F.sum("drawn").alias("total"))
    report = report.join(total, "request_id").select("request_id", "category", "need", "supply", "drawn", "target_share", F.try_divide("drawn", "total").alias("share"))
    return sample, report
