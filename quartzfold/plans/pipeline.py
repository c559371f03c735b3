"""Nested evaluation driven by a configuration: preparation, inner and outer cycle, results."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfold.operators import evaluation, experiment, features, models, sampling, scorers
from quartzfold.operators.experiment import RunConfig, metric_at
from quartzfold.operators.density import density_tree
from quartzfold.session import local_session, materialize
from quartzfold.sources import shared
from quartzfold.sources.tables import table

#: Metrics that are kept for every alert rate beside the main one.
RATE_METRICS = ("precision", "recall", "f1", "TP", "FP")
HISTORY_FOLDER, SUMMARY_FILE, PARAMETERS_FILE, REPORT_FILE = "history", "best_summary.csv", "best_parameters.json", "outer_report.csv"


# --- preparation ------------------------------------------------------------------


def prepare(rows: DataFrame, config: RunConfig, key: str = "row_id") -> DataFrame:
    """Folds in the space of the configured distance: (fold, id, vector, Class, part).

    ``rows`` has fold, part (train or another name), ``key``, Class and the raw
    columns. Per fold, and fitted on its training part only: copies of a training
    row are left out, the configured columns are standardised, and the space is
    centred (euclidean) or whitened (mahalanobis, mahalanobis_mcd), so that the
    origin is the training centre. Rows with a null feature are left out.
    """
    names = config.features
    x = features.derive(rows, config.excluded, keep=["fold", "part", key, "Class"]).dropna(subset=names)
    x = materialize(x.select("fold", "part", F.col(key).alias("id"), "Class", *names), "features")
    out = None
    for fold in sorted(r[0] for r in x.select("fold").distinct().collect()):
        own = x.where(F.col("fold") == fold)
        train = materialize(sampling.keep_first(own.where("part = 'train'"), names, "id"), "train")
        scaler = features.standard_scaler(train, config.scaled)
        scaled = scaler.apply(train)
        if config.distance == "euclidean":
            centre = features.centre_scaler(scaled, names)
            w = features.Whitener(tuple(names), np.array(centre.location), np.eye(len(names)), 0)
        elif config.distance == "mahalanobis":
            w = features.empirical_whitener(scaled, names)
        else:
            w = features.robust_whitener(scaled, names, seed=config.seed, key="id")
        both = scaler.apply(train.unionByName(own.where("part <> 'train'")))
        ready = w.apply(both, keep=("fold", "id", "Class", "part")).select("fold", "id", "vector", "Class", "part")
        out = ready if out is None else out.unionByName(ready)
    return out


def nested_folds(rows: DataFrame, config: RunConfig, key: str = "row_id") -> tuple[DataFrame, DataFrame, dict[int, float]]:
    """Outer folds (train, test), inner folds (train, val) of their training parts, and the weight of class 0 by fold.

    On the undersampled base only training parts are drawn from; an inner
    training part keeps what the outer one kept.
    """
    known = rows.where("Class is not null")
    f = materialize(sampling.stratified_folds(known, "Class", config.folds, config.seed, key).withColumnRenamed("fold", "own"), "folds")
    of = f.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(1, config.folds + 1)])))
    outer = of.withColumn("part", F.when(F.col("own") == F.col("fold"), "test").otherwise("train")).drop("own")
    inner = sampling.holdout(outer.where("part = 'train'").drop("part"), "Class", 0.2, config.seed, ["fold"], key)
    inner = inner.withColumn("part", F.when(F.col("is_val"), "val").otherwise("train")).drop("is_val")
    if config.base == "full":
        return outer, inner, {}
    outer, sizes = sampling.undersampled_parts(outer, "Class", config.legitimate, config.seed, key)
    outer = materialize(outer, "outer")
    kept = outer.where("part = 'train'").select("fold", key)
    inner = inner.where("part = 'val'").unionByName(inner.where("part = 'train'").join(kept, ["fold", key], "left_semi"))
    return outer, inner, {fold: before / max(after, 1) for fold, (before, after) in sizes.items()}


# --- cycles --------------------------------------------------------------------


def history_columns(config: RunConfig, inner: bool = True) -> list[tuple[str, str]]:
    """Columns of a trial's row and their types."""
    metrics = ("f1", "precision", "recall", "auprc") if inner else ("precision", "recall", "f1", "auprc")
    out = [("fold", "int"), ("combo_id", "int"), ("min_cluster_size", "int"), ("min_samples", "int")]
    if inner:
        out += [(f"{m}_score", "double") for m in config.metrics] + [("n_clusters", "bigint"), ("n_noise_points", "bigint")]
    out += [(m, "double") for m in metrics]
    out += [(f"auprc_{s}", "double") for s in config.scores if s != config.score]
    out += [(c, "bigint") for c in ("TP", "FP", "FN")]
    out += [(metric_at(m, r), "bigint" if m in ("TP", "FP") else "double") for r in config.rates for m in RATE_METRICS]
    return [*out, ("train_time_min", "double"), ("val_time_min" if inner else "predict_time_min", "double")]


def _evaluate(config: RunConfig, combos: Sequence[Mapping], weights: Mapping[int, float], inner: bool):
    """All combinations of one fold and min_samples: neighbours and trees are found once for them."""
    columns = history_columns(config, inner)
    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    # Trees of points before and after whitening differ, min_samples too; DISCO has a parameter of its own.
    most = max((c["min_samples"] for c in combos), default=1)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        fold, m = t.column("fold")[0].as_py(), t.column("min_samples")[0].as_py()
        wanted = set(t.column("combos")[0].as_py())
        x, y = np.array(t.column("vector").to_pylist(), float), t.column("Class").to_numpy()
        train = np.array(t.column("part").to_pylist()) == "train"
        own = np.flatnonzero(train)[scorers.distinct_first(x[train])]
        a, b, known, truth = x[own], x[~train], y[own], y[~train]
        began = time.perf_counter()
        near, tree = scorers.Neighbours(a, b, min(m, most)), density_tree(a, m)
        spent = time.perf_counter() - began
        disco_tree = None
        if inner and "disco" in config.metrics:
            disco_tree = tree if m == config.disco_points else density_tree(a, config.disco_points)
        rows = []
        for c in combos:
            if c["combo_id"] not in wanted:
                continue
            began = time.perf_counter()
            fit = scorers.Fit(near, c["min_cluster_size"], m, tree)
            row = {"fold": fold, **c, "train_time_min": (time.perf_counter() - began + spent) / 60}
            if inner:
                row |= {f"{k}_score": scorers.VALIDITY[k](a, fit.label, config, disco_tree) for k in config.metrics}
                row |= {"n_clusters": len(set(fit.label[fit.label >= 0].tolist())), "n_noise_points": int((fit.label < 0).sum())}
            began = time.perf_counter()
            pairs = {s: scorers.SCORERS[s](fit) for s in config.scores}
            s, e = pairs[config.score]
            at = lambda rate: scorers.threshold(s, rate, known, weights.get(fold, 1.0))
            row |= scorers.alert_metrics(truth, e, at(config.alert_rate))
            row["val_time_min" if inner else "predict_time_min"] = (time.perf_counter() - began) / 60
            row |= {f"auprc_{k}" if k != config.score else "auprc": scorers.step_average_precision((truth == 1).astype(int), v[1]) for k, v in pairs.items()}
            for rate in config.rates:
                other = scorers.alert_metrics(truth, e, at(rate))
                row |= {metric_at(k, rate): other[k] for k in RATE_METRICS}
            rows.append(row)
        return pa.table({k: pa.array([r[k] for r in rows], types[v]) for k, v in columns})

    return run


def trials(folds: DataFrame, combos: Sequence[Mapping], config: RunConfig, weights: Mapping[int, float] | None = None, done: DataFrame | None = None, inner: bool = True) -> DataFrame:
    """A row for every pending combination on every fold; a task per fold and min_samples.

    ``folds`` has fold, id, vector, Class and part as :func:`prepare` gives them;
    the training part of a fold must fit a task. ``combos`` are combo_id,
    min_cluster_size and min_samples. Rows of a saved history are not computed again.
    """
    spark = folds.sparkSession
    combos = [{k: int(c[k]) for k in ("combo_id", "min_cluster_size", "min_samples")} for c in combos]
    grid = spark.createDataFrame([(c["combo_id"], c["min_samples"]) for c in combos], "combo_id int, min_samples int")
    # Folds are few: their numbers times the grid are the jobs.
    jobs = folds.select("fold").distinct().withColumn("combo_id", F.explode(F.array(*[F.lit(c["combo_id"]) for c in combos]))).join(grid, "combo_id")
    if done is not None:
        jobs = experiment.pending(jobs, done)
    jobs = jobs.groupBy("fold", "min_samples").agg(F.sort_array(F.collect_list("combo_id")).alias("combos"))
    schema = ", ".join(f"`{k}` {v}" for k, v in history_columns(config, inner))
    rows = folds.join(jobs, "fold").select("fold", "min_samples", "combos", "id", "vector", F.col("Class").cast("int").alias("Class"), "part")
    return rows.groupBy("fold", "min_samples").applyInArrow(_evaluate(config, combos, weights or {}, inner), schema)


def combinations(spark: SparkSession, config: RunConfig) -> list[dict]:
    return [r.asDict() for r in experiment.grid(spark, config.grid_values).collect()]


def inner_cycle(folds: DataFrame, config: RunConfig, weights: Mapping[int, float] | None = None, folder: str | None = None, resume: bool = False, only_folds: Sequence[int] | None = None) -> DataFrame:
    """The grid search on the inner folds; with a folder the history is kept there and can be resumed."""
    spark = folds.sparkSession
    if only_folds:
        folds = folds.where(F.col("fold").isin(list(only_folds)))
    combos = combinations(spark, config)
    if folder is None:
        return materialize(trials(folds, combos, config, weights), "history")
    path = f"{folder}/{HISTORY_FOLDER}"
    experiment.guard(spark, folder, config, resume)
    columns = [k for k, _ in history_columns(config)]
    saved = experiment.read_history(spark, path, columns) if resume else None
    if not resume:
        shared.delete(spark, path)
    # A fold's rows are kept as soon as they are there.
    for fold in sorted(r[0] for r in folds.select("fold").distinct().collect()):
        new = materialize(trials(folds.where(F.col("fold") == fold), combos, config, weights, saved), "trials")
        if not new.isEmpty():
            experiment.append_history(new, path)
    return experiment.read_history(spark, path, columns).select([f"`{c}`" for c in columns])


def select_best(history: DataFrame, config: RunConfig) -> tuple[DataFrame, dict[int, dict]]:
    """The best trial of each fold by the selection metric, and its parameters and metric by fold."""
    column = config.selection_column
    best = experiment.best_per_fold(history, column)
    by_fold = {r["fold"]: {**{k: r[k] for k in config.grid_values}, f"best_{column}": r[column]} for r in best.collect()}
    return best, dict(sorted(by_fold.items()))


def best_configuration(by_fold: Mapping[int, Mapping], config: RunConfig) -> dict[str, int]:
    """Parameters of the fold whose best trial is the best, the first of equal ones."""
    key = f"best_{config.selection_column}"
    best = max(by_fold.values(), key=lambda v: v[key])
    return {k: int(best[k]) for k in config.grid_values}


def save_inner(history: DataFrame, best: DataFrame, by_fold: Mapping[int, Mapping], folder: str) -> None:
    """The best trial of each fold as CSV and the parameters as JSON; the history is there already."""
    shared.write_csv(history.sparkSession, f"{folder}/{SUMMARY_FILE}", [r.asDict() for r in best.orderBy("fold").collect()], history.columns)
    shared.write_text(history.sparkSession, f"{folder}/{PARAMETERS_FILE}", json.dumps(by_fold, indent=4))


def outer_cycle(folds: DataFrame, params: Mapping[str, int], config: RunConfig, weights: Mapping[int, float] | None = None) -> DataFrame:
    """The chosen configuration on every outer fold."""
    return materialize(trials(folds, [{"combo_id": 0, **params}], config, weights, inner=False).drop("combo_id"), "outer")


def with_summary(report: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Fold rows as text-keyed rows, and after them mean and sample deviation."""
    metrics = [c for c in report.columns if c != "fold"] if metrics is None else metrics
    rows = report.select(F.col("fold").cast("string").alias("fold"), *[F.col(f"`{m}`").cast("double").alias(m) for m in metrics])
    mean = rows.agg(*[F.avg(f"`{m}`").alias(m) for m in metrics]).withColumn("fold", F.lit("mean"))
    deviation = rows.agg(*[F.stddev_samp(f"`{m}`").alias(m) for m in metrics]).withColumn("fold", F.lit("deviation"))
    return rows.unionByName(mean).unionByName(deviation)


def save_report(report: DataFrame, folder: str) -> str:
    """The outer report as one CSV file, folds first; returns its path."""
    place = {"mean": 1, "deviation": 2}
    rows = sorted((r.asDict() for r in report.collect()), key=lambda r: (place.get(r["fold"], 0), len(r["fold"]), r["fold"]))
    return shared.write_csv(report.sparkSession, f"{folder}/{REPORT_FILE}", rows, report.columns)


def line(row: Mapping, config: RunConfig) -> str:
    """Parameters and metrics of a row for people to read."""
    shown = [f"{k}={int(row[k])}" for k in config.grid_values if row.get(k) is not None]
    names = [*[f"{m}_score" for m in config.metrics], "precision", "recall", "f1", "auprc", *[f"auprc_{s}" for s in config.scores], *[metric_at("f1", r) for r in config.rates]]
    return " | ".join([*shown, *[f"{n}={row[n]:.3f}" for n in names if row.get(n) is not None]])


def run(rows: DataFrame, config: RunConfig, folder: str, resume: bool = False, only_folds: Sequence[int] | None = None, say=print) -> str:
    """Inner cycle, selection, outer cycle and report of one configuration; returns the report's path.

    ``rows`` has row_id, Time, V1 .. V28, Amount and Class.
    """
    outer, inner, weights = nested_folds(rows, config)
    history = inner_cycle(materialize(prepare(inner, config), "inner"), config, weights, folder, resume, only_folds)
    best, by_fold = select_best(history, config)
    save_inner(history, best, by_fold, folder)
    for r in best.orderBy("fold").collect():
        say(f"inner fold {r['fold']}: {line(r.asDict(), config)}")
    params = best_configuration(by_fold, config)
    report = with_summary(outer_cycle(materialize(prepare(outer, config), "outer"), params, config, weights))
    for r in report.orderBy("fold").collect():
        say(f"outer {r['fold']}: {line(r.asDict(), config)}")
    return save_report(report, folder)


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Nested evaluation of density clustering on transactions.")
    p.add_argument("--base", choices=experiment.BASES, required=True)
    p.add_argument("--distance", choices=experiment.DISTANCES, required=True)
    p.add_argument("--data", required=True, help="folder of the tables")
    p.add_argument("--results", required=True, help="folder of the results")
    p.add_argument("--resume", action="store_true", help="keep what the saved history has")
    p.add_argument("--folds", type=int, nargs="+", help="inner folds to run, all by default")
    p.add_argument("--min-samples", type=int, nargs="+")
    p.add_argument("--min-cluster-size", type=int, nargs="+")
    return p.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    """One run from the command line."""
    a = arguments(argv)
    grid = {k: tuple(v) for k, v in (("min_samples", a.min_samples), ("min_cluster_size", a.min_cluster_size)) if v}
    config = RunConfig(base=a.base, distance=a.distance, **grid)
    spark = spark or SparkSession.getActiveSession() or local_session()
    folder = shared.fold_paths(a.results, a.base).results_dir(a.results, f"hdbscan_{a.distance}")
    print(f"base {a.base}, distance {a.distance}, grid {config.grid_values}, selection by {config.selection}, alerts by {config.score} at {config.alert_rate:g}")
    path = run(table(spark, a.data, "creditcard"), config, folder, a.resume, a.folds)
    print(f"report in {path}")
    return path


# --- supervised ----------------------------------------------------------------


def supervised_search(folds: DataFrame, grid: Sequence[dict], kind: str, columns: Sequence[str], weights: Mapping[int, float] | None = None, done: set[tuple[int, int]] = frozenset(), keep=None) -> DataFrame | None:
    """A model per pending combination and fold: (fold, combo_id, metrics, seconds); None if nothing is pending.

    ``folds`` has fold, part, Class and the features. Every fit is a distributed
    job of its own; ``keep`` gets each row as soon as it is there.
    """
    out = None
    for fold in sorted(r[0] for r in folds.select("fold").distinct().collect()):
        own = folds.where(F.col("fold") == fold)
        train, rest = own.where("part = 'train'"), own.where("part <> 'train'")
        for combo_id, params in enumerate(grid):
            if (fold, combo_id) in done:
                continue
            params = experiment.clean_parameters(params)
            began = time.perf_counter()
            scored = models.fit_predict(kind, params, train, rest, columns, weight=(weights or {}).get(fold, 1.0), class_weight=params.get("class_weight"))
            fitted = (time.perf_counter() - began) / 60
            m = evaluation.confusion(scored, "predicted", "Class", ["fold"]).join(evaluation.average_precision(scored, "score", "Class", ["fold"]), "fold")
            m = m.withColumns({"combo_id": F.lit(combo_id), "train_time_min": F.lit(fitted)})
            if keep is not None:
                m = materialize(m, "trial")
                keep(m)
            out = m if out is None else out.unionByName(m)
    return out


def manual_grid_search(folds: DataFrame, values: Mapping[str, Sequence], kind: str, columns: Sequence[str], folder: str, metric: str = "average_precision", weights: Mapping[int, float] | None = None, resume: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """Search with a kept history: (rows by fold, means by combination, best parameters by mean)."""
    spark = folds.sparkSession
    experiment.guard(spark, folder, {"kind": kind, "grid": {k: list(v) for k, v in values.items()}, "columns": list(columns)}, resume)
    path = f"{folder}/{HISTORY_FOLDER}"
    if not resume:
        shared.delete(spark, path)
    saved = experiment.read_history(spark, path, ["combo_id"]) if resume else None
    done = {(r["fold"], r["combo_id"]) for r in saved.select("fold", "combo_id").collect()} if saved is not None else set()
    combos = experiment.configurations(values)
    supervised_search(folds, combos, kind, columns, weights, done, keep=lambda row: experiment.append_history(row, path))
    history = experiment.read_history(spark, path, [metric])
    means = experiment.summary(history, ["f1", "precision", "recall", "average_precision", "train_time_min"])
    best = means.orderBy(F.desc_nulls_last(metric), "combo_id").first()
    shared.write_csv(spark, f"{folder}/{SUMMARY_FILE}", [r.asDict() for r in means.orderBy("combo_id").collect()], means.columns)
    return history, means, experiment.clean_parameters(combos[best["combo_id"]])


def outer_supervised(folds: DataFrame, params: Mapping, kind: str, columns: Sequence[str], weights: Mapping[int, float] | None = None) -> DataFrame:
    """One configuration on every outer fold, with mean and deviation."""
    return with_summary(supervised_search(folds, [dict(params)], kind, columns, weights).drop("combo_id"))


if __name__ == "__main__":
    main()
