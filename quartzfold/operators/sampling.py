"""Folds and samples: pure functions of a seed and the row ids."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzfold.functions.ordering import hash_rank


def resolve_target(columns: Sequence[str], target: str | int) -> str:
    """The name of the target column, given by name or by position from 0."""
    if isinstance(target, bool) or not isinstance(target, (str, int)):
        raise TypeError("the target is a column name or a position")
    if isinstance(target, int):
        if not 0 <= target < len(columns):
            raise IndexError(f"no column {target}")
        return columns[target]
    if target not in columns:
        raise ValueError(f"no column named {target!r}")
    return target


def stratified_folds(df: DataFrame, target: str = "Class", folds: int = 5, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Adds ``fold`` (from 1): every row in one fold, classes spread evenly, sizes differ by at most 1.

    Classes follow each other in one cycle of folds. Rows of the null class are a
    class of their own. More folds than rows raise; fewer rows of a class than
    folds only warn.
    """
    sizes = df.groupBy(target).agg(F.count("*").alias("n"))
    n = sizes.agg(F.sum("n"), F.min("n")).first()
    if folds < 2 or folds > (n[0] or 0):
        raise ValueError("folds must be between 2 and the number of rows")
    if n[1] < folds:
        warnings.warn("a class has fewer rows than folds", stacklevel=2)
    before = Window.orderBy(target).rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    starts = sizes.select(F.col(target).alias("__class"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    ranked = hash_rank(df, [target], seed, key, "__rank")
    out = ranked.join(starts, ranked[target].eqNullSafe(starts["__class"]))
    return out.select(*df.columns, (F.pmod(F.col("__rank") - 1 + F.col("__start"), F.lit(folds)) + 1).cast("int").alias("fold"))


def holdout(df: DataFrame, target: str, share: float, seed: int = 42, by: Sequence[str] = (), key: str = "row_id") -> DataFrame:
    """Adds ``is_val``: per group and class the rounded-up share of rows, chosen by hash."""
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    ranked = hash_rank(df, [*by, target], seed, key, "__rank")
    sizes = df.groupBy(*by, target).agg(F.count("*").alias("__n")).select(*[F.col(c).alias(f"__{c}") for c in [*by, target]], "__n")
    match = F.lit(True)
    for c in [*by, target]:
        match = match & ranked[c].eqNullSafe(sizes[f"__{c}"])
    return ranked.join(sizes, match).select(*df.columns, (F.col("__rank") <= F.ceil(F.col("__n") * share - 1e-9)).alias("is_val"))


def undersample(df: DataFrame, target: str, fraction: float, seed: int | str = 42, by: Sequence[str] = (), key: str = "row_id") -> DataFrame:
    """All rows of class 1 and, per group, the rounded fraction of class 0; rows of no class are dropped."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    zero = df.where(F.col(target) == 0)
    ranked = hash_rank(zero, list(by), seed, key, "__rank")
    if by:
        sizes = zero.groupBy(*by).agg(F.count("*").alias("__n"))
        kept = ranked.join(sizes, list(by)).where(F.col("__rank") <= F.round(F.col("__n") * fraction))
    else:
        kept = ranked.where(F.col("__rank") <= round_half_up(zero.count() * fraction))
    return kept.select(*df.columns).unionByName(df.where(F.col(target) == 1))


def round_half_up(x: float) -> int:
    return int(x + 0.5)


def legitimate_fraction(zeros: int, target: int) -> float:
    """Share of class 0 to keep so that ``target`` rows are left."""
    if not 1 <= target <= zeros:
        raise ValueError("the target lies outside 1 .. number of rows of class 0")
    return target / zeros


def keep_first(df: DataFrame, columns: Sequence[str], key: str = "row_id") -> DataFrame:
    """Of rows equal in ``columns`` (nulls are equal) the one with the smallest key."""
    first = df.groupBy(*columns).agg(F.min(key).alias(key)).select(key)
    return df.join(first, key, "left_semi")


def quota_sample(df: DataFrame, label: str, size: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """At most ``size`` rows, labels in proportion (largest remainder, ties by label), chosen by hash."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= size:
        return df
    share = F.col("n") * F.lit(size) / F.lit(total)
    whole = sizes.withColumn("whole", F.floor(share)).withColumn("rest", share - F.floor(share))
    left = size - whole.agg(F.sum("whole")).first()[0]
    place = F.row_number().over(Window.orderBy(F.desc(F.round("rest", 9)), label))  # one row per label
    quota = whole.select(F.col(label).alias("__label"), (F.col("whole") + (place <= left).cast("int")).alias("__quota"))
    ranked = hash_rank(df, [label], seed, key, "__rank")
    return ranked.join(quota, ranked[label].eqNullSafe(quota["__label"])).where("__rank <= __quota").select(*df.columns)


def overlap(sets: DataFrame) -> DataFrame:
    """Percentage of fold a's rows that fold b has too, all pairs: (fold_a, fold_b, overlap).

    ``sets`` has distinct (fold, row_id). A row's folds meet within the row: no
    self join of all rows. There are few folds.
    """
    sizes = sets.groupBy(F.col("fold").alias("fold_a")).agg(F.count("*").alias("size"))
    held = sets.groupBy("row_id").agg(F.collect_set("fold").alias("f"))
    both = held.select(F.explode("f").alias("fold_a"), "f").select("fold_a", F.explode("f").alias("fold_b")).groupBy("fold_a", "fold_b").agg(F.count("*").alias("both"))
    # The grid of folds from one row that holds them all.
    names = sizes.agg(F.collect_set("fold_a").alias("f"))
    grid = names.select(F.explode("f").alias("fold_a"), "f").select("fold_a", F.explode("f").alias("fold_b"))
    return grid.join(sizes, "fold_a").join(both, ["fold_a", "fold_b"], "left").select("fold_a", "fold_b", (100.0 * F.coalesce("both", F.lit(0)) / F.col("size")).alias("overlap"))


def undersampled_parts(rows: DataFrame, target: str, legitimate: int, seed: int = 42, key: str = "row_id") -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Folds whose training part keeps ``legitimate`` rows of class 0, other parts as they are.

    ``rows`` has fold and part. Every fold is drawn with a seed of its own, made
    of the seed and the fold. Where inner folds share a fold's number they keep
    what the outer training part kept: draw once and join. Also returns per fold
    the rows of class 0 before and after.
    """
    train = rows.where("part = 'train'")
    counts = {r[0]: r[1] for r in train.where(F.col(target) == 0).groupBy("fold").count().collect()}
    out, sizes = rows.where("part <> 'train'"), {}
    for fold in sorted(r[0] for r in rows.select("fold").distinct().collect()):
        n = counts.get(fold, 0)
        fraction = legitimate_fraction(n, min(legitimate, n)) if n else 1.0
        out = out.unionByName(undersample(train.where(F.col("fold") == fold), target, fraction, f"{seed}-{fold}", key=key))
        sizes[fold] = (n, round_half_up(n * fraction))
    return out, sizes
