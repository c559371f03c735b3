"""Distributed ranks and running sums.

A window without partitions would put all rows into one task. Here the order is
cut into lanes, lanes are ranked or summed on their own, and the lanes' totals,
a table of at most a few thousand rows per group, give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzfold.session import materialize

#: Lanes of a running sum.
LANES = 64


def hash_of(seed: int | str, key: str = "row_id") -> Column:
    """Hexadecimal digest of seed and key: the same in every engine and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def hash_rank(df: DataFrame, by: Sequence[str], seed: int | str, key: str = "row_id", name: str = "rank") -> DataFrame:
    """Adds the rank (from 1) by digest within the groups ``by``; null groups count as one group."""
    digest, lane = f"__{name}_digest", f"__{name}_lane"
    laned = df.withColumn(digest, hash_of(seed, key)).withColumn(lane, F.substring(digest, 1, 3))
    own = Window.partitionBy(*by, lane).orderBy(digest, key)
    ranked = laned.withColumn(name, F.row_number().over(own))
    before = Window.partitionBy(*by).orderBy(lane).rowsBetween(Window.unboundedPreceding, -1)
    offsets = laned.groupBy(*by, lane).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col(lane).alias("__lane"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    match = ranked[lane] == offsets["__lane"]
    for c in by:
        match = match & ranked[c].eqNullSafe(offsets[f"__by_{c}"])
    out = ranked.join(offsets, match).withColumn(name, (F.col(name) + F.col("__offset")).cast("bigint"))
    return out.select(*df.columns, name)


def running(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Adds ``cum_<c>``: the sum of c over rows of the group up to and including this one.

    ``order`` must be numeric and unique within a group: aggregate ties first.
    Every group is cut into lanes at quantiles of its own, so that a group of
    another range than the rest does not fall into one lane. The quantiles
    depend on the order in which partitions are merged, so they are taken once:
    sums and offsets by different lanes would not fit.
    """
    df = materialize(df, "ordered")  # read three times below
    cuts = F.percentile_approx(F.col(order).cast("double"), [i / LANES for i in range(1, LANES)], 1000).alias("__cuts")
    below = lambda held: F.size(F.filter(F.array_distinct(held), lambda c: c <= F.col(order).cast("double")))
    if by:
        laned = df.join(materialize(df.groupBy(*by).agg(cuts), "cuts"), list(by)).withColumn("__lane", below(F.col("__cuts"))).drop("__cuts")
    else:
        held = df.agg(cuts).first()[0] or []
        laned = df.withColumn("__lane", below(F.array(*[F.lit(float(c)) for c in held])) if held else F.lit(0))
    turn = F.desc if descending else F.asc
    own = Window.partitionBy(*by, "__lane").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = laned.withColumns({f"cum_{c}": F.sum(c).over(own) for c in sums})
    before = Window.partitionBy(*by).orderBy(turn("__lane")).rowsBetween(Window.unboundedPreceding, -1)
    totals = laned.groupBy(*by, "__lane").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    totals = totals.select(*by, "__lane", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums])
    out = out.join(totals, [*by, "__lane"])
    return out.select(*df.columns, *[(F.col(f"cum_{c}") + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in sums])
