"""The registered queries of the core operators, with the same results in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzfold.functions.ordering import hash_of, hash_rank
from quartzfold.operators import density, evaluation, experiment, features, models, neighbors, reports, sampling, scores, statistics, validity
from quartzfold.plans import pipeline
from quartzfold.session import materialize
from quartzfold.sources.tables import V_COLUMNS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            # A count must be BIGINT, not HUGEINT.
            SQL[f.__name__] = re.sub(r"count_if\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"count(*) FILTER (WHERE \1)", sql)
        return f

    return add


# --- sources -------------------------------------------------------------------

KNOWN = "Class IS NOT NULL AND Time IS NOT NULL AND Amount IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in V_COLUMNS)
SCORE = "round(abs(V3) + abs(V10) + abs(V14) + abs(V17), 4)"
BASE = f"base AS (SELECT *, {SCORE} AS score FROM creditcard WHERE {KNOWN})"


def base(spark: SparkSession, d: str) -> DataFrame:
    """Transactions without nulls, with a plain score to evaluate."""
    return table(spark, d, "creditcard").dropna(subset=["Class", "Time", "Amount", *V_COLUMNS]).withColumn("score", F.expr(SCORE))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events as rows of (row_id, seconds, Amount, Class)."""
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = e.agg(F.min(us)).first()[0]
    return e.select(F.col("event_id").alias("row_id"), ((us - F.lit(start)) / 1e6).alias("Time"), F.col("value").alias("Amount"), (F.col("event_type") == "error").cast("int").alias("Class"))


EVENTS = "ev AS (SELECT event_id AS row_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS Time, value AS Amount, CAST(event_type = 'error' AS INTEGER) AS Class FROM events)"
VECTORS = "vec AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hdbscan_grid_results_by_fold")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    # The sum turns -0 into 0.
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# --- folds and samples ------------------------------------------------------------

FOLDS = f"""{BASE},
folds AS (SELECT b.* EXCLUDE (rank), CAST((b.rank - 1 + c.start) % 5 + 1 AS INTEGER) AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY Class ORDER BY md5('42:' || row_id), row_id) AS rank FROM base) b
JOIN (SELECT Class, sum(n) OVER (ORDER BY Class) - n AS start FROM (SELECT Class, count(*) AS n FROM base GROUP BY Class)) c ON b.Class = c.Class)"""


def folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_folds(base(spark, d), "Class", 5)


@query(f"WITH {FOLDS} SELECT row_id, fold FROM folds")
def stratified_folds(spark, d):
    return folds(spark, d).select("row_id", "fold")


@query(f"WITH {FOLDS} SELECT fold, Class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY fold), 6) AS share FROM folds GROUP BY fold, Class")
def fold_class_distribution(spark, d):
    c = folds(spark, d).groupBy("fold", "Class").agg(F.count("*").alias("n"))
    return rounded(c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("fold"))), "share")


OUTER = f"{FOLDS}, o AS (SELECT *, outer_fold FROM folds, (SELECT unnest([1, 2, 3, 4, 5]) AS outer_fold) WHERE fold <> outer_fold)"


def outer_training(spark: SparkSession, d: str) -> DataFrame:
    """Every training row once per outer fold."""
    return folds(spark, d).select("row_id", "Class", "Amount", "score", "fold", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("outer_fold")).where("fold <> outer_fold")


@query(f"""WITH {OUTER}, r AS (SELECT *, row_number() OVER (PARTITION BY outer_fold, Class ORDER BY md5('42:' || row_id), row_id) <= ceil(count(*) OVER (PARTITION BY outer_fold, Class) * 0.2 - 1e-9) AS is_val FROM o)
SELECT outer_fold, is_val, Class, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM r GROUP BY ALL""")
def inner_holdout(spark, d):
    return sampling.holdout(outer_training(spark, d), "Class", 0.2, by=["outer_fold"]).groupBy("outer_fold", "is_val", "Class").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query(f"WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY Class ORDER BY md5('42:' || row_id), row_id) AS rank, count(*) OVER (PARTITION BY Class) AS n FROM base) SELECT row_id, Class FROM r WHERE Class = 1 OR rank <= floor(n * 0.5 + 0.5)")
def undersample_legit(spark, d):
    return sampling.undersample(base(spark, d), "Class", 0.5).select("row_id", "Class")


@query(f"WITH {OUTER}, r AS (SELECT *, row_number() OVER (PARTITION BY outer_fold, Class ORDER BY md5('42:' || row_id), row_id) AS rank, count(*) OVER (PARTITION BY outer_fold, Class) AS n FROM o) SELECT outer_fold, Class, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM r WHERE Class = 1 OR rank <= round(n * 0.5) GROUP BY ALL")
def undersampled_folds(spark, d):
    return sampling.undersample(outer_training(spark, d), "Class", 0.5, by=["outer_fold"]).groupBy("outer_fold", "Class").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query(f"WITH {BASE}, c AS (SELECT count_if(Class = 0) AS zeros, count_if(Class = 1) AS ones FROM base) SELECT zeros, ones, round(ones * 10 / zeros, 6) AS fraction, round(zeros / floor(zeros * (ones * 10 / zeros) + 0.5), 6) AS weight FROM c")
def legit_fraction_and_weight(spark, d):
    c = base(spark, d).agg(F.count_if(F.col("Class") == 0).alias("zeros"), F.count_if(F.col("Class") == 1).alias("ones")).withColumn("fraction", F.col("ones") * 10 / F.col("zeros"))
    return rounded(c.withColumn("weight", F.col("zeros") / F.floor(F.col("zeros") * F.col("fraction") + 0.5)), "fraction", "weight")


PARTS = "parts AS (SELECT DISTINCT fold, lower(trim(part)) AS part, row_id FROM fold_partition WHERE part IS NOT NULL)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fold_partition").where("part is not null").select("fold", F.lower(F.trim("part")).alias("part"), "row_id").distinct()


@query(f"WITH {PARTS} SELECT times, count(*) AS n FROM (SELECT row_id, count(*) AS times FROM parts WHERE part = 'test' GROUP BY row_id) GROUP BY times")
def fold_coverage(spark, d):
    return parts(spark, d).where("part = 'test'").groupBy("row_id").agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("n"))


@query(f"WITH {PARTS}, o AS (SELECT DISTINCT fold, row_id FROM parts WHERE part = 'test'), s AS (SELECT fold, count(*) AS n FROM o GROUP BY 1), p AS (SELECT a.fold AS fold_a, b.fold AS fold_b, count(*) AS n FROM o a JOIN o b ON a.row_id = b.row_id GROUP BY ALL) SELECT x.fold AS fold_a, y.fold AS fold_b, coalesce(round(100.0 * p.n / x.n, 6), 0) AS overlap FROM s x CROSS JOIN s y LEFT JOIN p ON p.fold_a = x.fold AND p.fold_b = y.fold")
def fold_overlap(spark, d):
    """Share of a fold's test rows that stand in another fold's test part too, all pairs of folds."""
    return rounded(sampling.overlap(parts(spark, d).where("part = 'test'").select("fold", "row_id").distinct()), "overlap")


@query(f"WITH {PARTS} SELECT p.fold, p.part, count(*) AS n, count_if(c.Class = 1) AS frauds, round(avg(CAST(c.Class = 1 AS INTEGER)), 6) AS rate FROM parts p JOIN creditcard c ON p.row_id = c.row_id WHERE c.Class IS NOT NULL GROUP BY ALL")
def fold_composition(spark, d):
    x = parts(spark, d).join(table(spark, d, "creditcard").where("Class is not null").select("row_id", "Class"), "row_id")
    return rounded(x.groupBy("fold", "part").agg(F.count("*").alias("n"), F.count_if(F.col("Class") == 1).alias("frauds"), F.avg((F.col("Class") == 1).cast("int")).alias("rate")), "rate")


FEATURES = ["Time", *V_COLUMNS, "Amount"]


@query(f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY {', '.join(FEATURES)} ORDER BY row_id) AS r FROM creditcard) WHERE r = 1")
def dedup_keep_first(spark, d):
    return sampling.keep_first(table(spark, d, "creditcard"), FEATURES).select("row_id")


@query(f"SELECT (SELECT count(*) FROM creditcard) AS n, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(FEATURES)} FROM creditcard)) AS points")
def distinct_points(spark, d):
    g = table(spark, d, "creditcard").groupBy(*FEATURES).agg(F.count("*").alias("c"))
    return g.agg(F.sum("c").alias("n"), F.count("*").alias("points"))


@query(f"""WITH {BASE}, b AS (SELECT * FROM base WHERE source IS NOT NULL), s AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS t FROM b GROUP BY source),
q AS (SELECT source, floor(n * 1000 / t) AS whole, n * 1000 / t - floor(n * 1000 / t) AS rest FROM s),
p AS (SELECT source, whole + CAST(row_number() OVER (ORDER BY round(rest, 9) DESC, source) <= 1000 - (SELECT sum(whole) FROM q) AS INTEGER) AS quota FROM q)
SELECT r.row_id, r.source FROM (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || row_id), row_id) AS rank FROM b) r JOIN p ON r.source = p.source WHERE rank <= quota""")
def stratified_quota_sample(spark, d):
    return sampling.quota_sample(base(spark, d).where("source is not null"), "source", 1000).select("row_id", "source")


@query(f"WITH {BASE}, r AS (SELECT row_id, Class, row_number() OVER (PARTITION BY Class ORDER BY md5('42:' || row_id), row_id) AS rank FROM base) SELECT row_id, Class FROM r WHERE Class = 1 OR rank <= 2000")
def plot_sample(spark, d):
    """All frauds and at most 2 000 legitimate rows, as they are drawn for plots."""
    b = base(spark, d)
    return hash_rank(b.where("Class = 0").select("row_id", "Class"), [], 42).where("rank <= 2000").drop("rank").unionByName(b.where("Class = 1").select("row_id", "Class"))


@query(f"WITH {VECTORS} SELECT id, CASE WHEN CAST('0x' || substr(md5('7:' || id), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 THEN -1 ELSE label END AS label FROM vec")
def noise_labels(spark, d):
    """Labels of which a share of 0.3, by hash, is made noise."""
    share = F.conv(F.substring(hash_of(7, "id"), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    return vectors(spark, d).select("id", F.when(share < 0.3, -1).otherwise(F.col("label")).alias("label"))


# --- features and scaling ----------------------------------------------------------

HOUR = "sin(2 * pi() * ((Time % 86400) / 3600) / 24)"


@query(f"SELECT row_id, {', '.join(V_COLUMNS)}, round(ln(1 + Amount), 6) AS log_amount, round({HOUR}, 6) AS hour_sin, round({HOUR.replace('sin', 'cos')}, 6) AS hour_cos FROM creditcard WHERE Amount IS NOT NULL AND Time IS NOT NULL")
def engineer_features(spark, d):
    return rounded(features.derive(table(spark, d, "creditcard").where("Amount is not null and Time is not null"), keep=["row_id"]), *features.DERIVED)


@query(f"""WITH {FOLDS}, f AS (SELECT row_id, fold, ln(1 + Amount) AS log_amount, Time FROM folds), s AS (SELECT avg(log_amount) AS m, stddev_pop(log_amount) AS s, avg(Time) AS mt, stddev_pop(Time) AS st FROM f WHERE fold <> 1)
SELECT row_id, round((log_amount - m) / s, 6) AS log_amount, round((Time - mt) / st, 6) AS Time FROM f, s WHERE fold = 1""")
def standard_scale(spark, d):
    f = folds(spark, d).select("row_id", "fold", F.log1p("Amount").alias("log_amount"), "Time")
    s = features.standard_scaler(f.where("fold <> 1"), ["log_amount", "Time"])
    return rounded(s.apply(f.where("fold = 1")).drop("fold"), "log_amount", "Time")


@query(f"""WITH {FOLDS}, s AS (SELECT median(Amount) AS m, quantile_cont(Amount, 0.75) - quantile_cont(Amount, 0.25) AS s FROM folds WHERE fold <> 1)
SELECT row_id, round((Amount - m) / s, 6) AS Amount FROM folds, s WHERE fold = 1""")
def robust_scale(spark, d):
    f = folds(spark, d).select("row_id", "fold", "Amount")
    return rounded(features.robust_scaler(f.where("fold <> 1"), ["Amount"]).apply(f.where("fold = 1")).drop("fold"), "Amount")


@query(f"WITH {FOLDS}, s AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in V_COLUMNS)} FROM folds WHERE fold <> 1) SELECT row_id, round(sqrt({' + '.join(f'({c} - m_{c}) * ({c} - m_{c})' for c in V_COLUMNS)}), 6) AS distance FROM folds, s WHERE fold = 1")
def center_only(spark, d):
    f = folds(spark, d).select("row_id", "fold", *V_COLUMNS)
    z = features.centre_scaler(f.where("fold <> 1"), V_COLUMNS).apply(f.where("fold = 1"))
    return rounded(z.select("row_id", F.sqrt(sum((F.col(c) * F.col(c) for c in V_COLUMNS), F.lit(0.0))).alias("distance")), "distance")


PAIRS = [(a, b) for i, a in enumerate(V_COLUMNS) for b in V_COLUMNS[i:]]


@query(f"WITH {BASE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 6) AS cov FROM base" for a, b in PAIRS))
def empirical_covariance(spark, d):
    _, cov, _ = features.covariance(base(spark, d), V_COLUMNS)
    at = {c: i for i, c in enumerate(V_COLUMNS)}
    return rounded(spark.createDataFrame([(a, b, float(cov[at[a], at[b]])) for a, b in PAIRS], "a string, b string, cov double"), "cov")


@query(f"WITH {BASE}, s AS (SELECT avg(Amount) AS m, stddev_pop(Amount) AS s, avg(ln(1 + Amount)) AS ml, stddev_pop(ln(1 + Amount)) AS sl FROM base) SELECT row_id, round((Amount - m) / s, 6) AS z, round((ln(1 + Amount) - ml) / sl, 6) AS z_log FROM base, s")
def zscore_amount(spark, d):
    b = base(spark, d).select("row_id", F.col("Amount").alias("z"), F.log1p("Amount").alias("z_log"))
    return rounded(features.standard_scaler(b, ["z", "z_log"]).apply(b), "z", "z_log")


@query(f"WITH {BASE}, m AS (SELECT avg(Amount) AS m, avg(ln(1 + Amount)) AS l FROM base) SELECT round(avg((Amount - m) ** 3) / avg((Amount - m) ** 2) ** 1.5, 6) AS skewness, round(avg((ln(1 + Amount) - l) ** 3) / avg((ln(1 + Amount) - l) ** 2) ** 1.5, 6) AS log_skewness FROM base, m")
def amount_skewness(spark, d):
    return rounded(base(spark, d).agg(F.skewness("Amount").alias("skewness"), F.skewness(F.log1p("Amount")).alias("log_skewness")), "skewness", "log_skewness")


MAHA = f"""WITH {BASE}, s AS (SELECT avg(V1) AS a, avg(V2) AS b, var_samp(V1) AS aa, var_samp(V2) AS bb, covar_samp(V1, V2) AS ab FROM base)
SELECT row_id, round(sqrt((bb * (V1 - a) ** 2 - 2 * ab * (V1 - a) * (V2 - b) + aa * (V2 - b) ** 2) / (aa * bb - ab * ab)), 6) AS distance FROM base, s"""


@query(MAHA)
def mahalanobis_center_distance(spark, d):
    b = base(spark, d)
    return rounded(features.empirical_whitener(b, ["V1", "V2"]).apply(b).select("row_id", "distance"), "distance")


@query()
def mcd_center_distance(spark, d):
    """Distance from the centre by the robust covariance, in all features of the final model."""
    f = features.derive(base(spark, d), excluded=["hour_sin", "hour_cos"], keep=["row_id"])
    columns = [c for c in f.columns if c != "row_id"]
    return rounded(features.robust_whitener(f, columns).apply(f).select("row_id", "distance"), "distance")


@query()
def ellipse_inside(spark, d):
    """Rows within the 97.5 % tolerance ellipse of two features, by class."""
    b = base(spark, d)
    w = features.robust_whitener(b, ["V1", "V2"]).apply(b, keep=("row_id", "Class"))
    return w.groupBy("Class").agg(F.count("*").alias("n"), F.count_if(F.col("distance") <= features.chi2_quantile(0.975, 2) ** 0.5).alias("inside"))


# --- thresholds and metrics ------------------------------------------------------------

ALERT = 0.02
THRESHOLD = f"t AS (SELECT fold, (SELECT quantile_cont(score, {1 - ALERT}) FROM folds x WHERE x.fold <> y.fold) AS threshold FROM (SELECT DISTINCT fold FROM folds) y)"
CONFUSION = "count_if(p AND Class = 1) AS TP, count_if(p AND Class <> 1) AS FP, count_if(NOT p AND Class = 1) AS FN, count_if(NOT p AND Class <> 1) AS TN"
DERIVED = "round(CASE WHEN TP + FP = 0 THEN 0 ELSE TP / (TP + FP) END, 6) AS precision, round(CASE WHEN TP + FN = 0 THEN 0 ELSE TP / (TP + FN) END, 6) AS recall, round(CASE WHEN 2 * TP + FP + FN = 0 THEN 0 ELSE 2 * TP / (2 * TP + FP + FN) END, 6) AS f1"


def thresholds(spark: SparkSession, d: str, rate: float) -> DataFrame:
    return evaluation.quantile_threshold(outer_training(spark, d), "score", rate, ["outer_fold"]).withColumnRenamed("outer_fold", "fold")


def alerts(spark: SparkSession, d: str, rate: float) -> DataFrame:
    return folds(spark, d).join(thresholds(spark, d, rate), "fold").withColumn("p", (F.col("score") >= F.col("threshold")).cast("int"))


@query(f"WITH {FOLDS}, {THRESHOLD} SELECT fold, round(threshold, 6) AS threshold FROM t")
def alert_threshold_quantile(spark, d):
    return rounded(thresholds(spark, d, ALERT), "threshold")


@query(f"""WITH {OUTER}, g AS (SELECT outer_fold, score, sum(CASE WHEN Class = 1 THEN 1.0 ELSE 3.0 END) AS w FROM o GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY outer_fold ORDER BY score) AS cum, sum(w) OVER (PARTITION BY outer_fold) AS total FROM g)
SELECT outer_fold, min(score) AS threshold FROM c WHERE cum >= total * {1 - ALERT} - 1e-9 GROUP BY outer_fold""")
def alert_threshold_weighted(spark, d):
    o = outer_training(spark, d).withColumn("w", F.when(F.col("Class") == 1, 1.0).otherwise(3.0))
    return evaluation.weighted_threshold(o, "score", "w", ALERT, ["outer_fold"])


@query(f"WITH {FOLDS}, {THRESHOLD}, a AS (SELECT f.fold, Class, score >= threshold AS p FROM folds f JOIN t ON f.fold = t.fold), c AS (SELECT fold, {CONFUSION} FROM a GROUP BY fold) SELECT fold, TP, FP, FN, TN, {DERIVED} FROM c")
def confusion_metrics(spark, d):
    return rounded(evaluation.confusion(alerts(spark, d, ALERT), "p", "Class", ["fold"]), "precision", "recall", "f1")


RATES = [0.005, 0.01, 0.02, 0.05]


@query(f"""WITH {FOLDS}, t AS (SELECT fold, rate, (SELECT quantile_cont(score, [{', '.join(str(1 - r) for r in RATES)}]) FROM folds x WHERE x.fold <> y.fold)[i] AS threshold
FROM (SELECT DISTINCT fold FROM folds) y, (SELECT unnest([1, 2, 3, 4]) AS i, unnest({RATES}::DOUBLE[]) AS rate)),
a AS (SELECT f.fold, rate, Class, score >= threshold AS p FROM folds f JOIN t ON f.fold = t.fold), c AS (SELECT fold, rate, {CONFUSION} FROM a GROUP BY ALL) SELECT fold, rate, TP, FP, FN, TN, {DERIVED} FROM c""")
def alert_metrics_by_rate(spark, d):
    # All rates from one pass over the training scores and one over the evaluated ones.
    t = evaluation.exact_quantiles(outer_training(spark, d), "score", [1 - r for r in RATES], ["outer_fold"]).select(F.col("outer_fold").alias("fold"), F.col("quantiles").alias("t"))
    x = folds(spark, d).select("fold", "Class", "score").join(t, "fold").select("fold", "Class", "score", F.explode(F.arrays_zip(F.array(*[F.lit(r) for r in RATES]).alias("rate"), "t")).alias("z"))
    x = x.select("fold", "Class", F.col("z")["rate"].alias("rate"), (F.col("score") >= F.col("z")["t"]).cast("int").alias("p"))
    return rounded(evaluation.confusion(x, "p", "Class", ["fold", "rate"]), "precision", "recall", "f1")


AP = """g AS (SELECT {by}, {score} AS s, count_if({label} = 1) AS pos, count_if({label} <> 1) AS neg FROM {src} WHERE {score} IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (PARTITION BY {by} ORDER BY s DESC)),
ap AS (SELECT {by}, coalesce(sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0), 0) AS average_precision, CAST(sum(pos) AS BIGINT) AS positives FROM c GROUP BY {by})"""


@query(f"WITH {FOLDS}, {AP.format(by='fold', score='score', label='Class', src='folds')} SELECT fold, round(average_precision, 6) AS average_precision, positives FROM ap")
def average_precision(spark, d):
    return rounded(evaluation.average_precision(folds(spark, d), "score", "Class", ["fold"]), "average_precision")


@query(f"""WITH {FOLDS}, g AS (SELECT fold, score, count_if(Class = 1) AS pos, count_if(Class <> 1) AS neg FROM folds GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY fold ORDER BY score) AS cum FROM g)
SELECT fold, round(sum(pos * (cum - neg / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c GROUP BY fold""")
def roc_auc(spark, d):
    return rounded(evaluation.roc_auc(folds(spark, d), "score", "Class", ["fold"]), "roc_auc")


@query("SELECT run_id, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM (SELECT run_id, unnest(['auprc', 'f1', 'TP']) AS metric, unnest([auprc, f1, CAST(TP AS DOUBLE)]) AS value FROM hdbscan_grid_results_by_fold) GROUP BY ALL")
def fold_summary(spark, d):
    h = history(spark, d).select("run_id", "auprc", "f1", F.col("TP").cast("double").alias("TP"))
    return rounded(evaluation.fold_summary(h, ["auprc", "f1", "TP"], ["run_id"]), "mean", "deviation")


@query("WITH c AS (SELECT count_if(p AND Class = 1) AS TP, count_if(p AND Class <> 1) AS FP, count_if(NOT p AND Class = 1) AS FN, count_if(NOT p AND Class <> 1) AS TN FROM (SELECT label = 9 AS p, CAST(vec_id % 7 = 0 AS INTEGER) AS Class FROM embeddings)) SELECT TP, FP, FN, TN, " + DERIVED + " FROM c")
def noise_as_fraud(spark, d):
    x = vectors(spark, d).select((F.col("label") == 9).cast("int").alias("p"), (F.col("id") % 7 == 0).cast("int").alias("Class"))
    return rounded(evaluation.confusion(x, "p", "Class"), "precision", "recall", "f1")


NESTED = f"""WITH {EVENTS},
f AS (SELECT b.*, CAST((b.rank - 1 + c.start) % 5 + 1 AS INTEGER) AS fold, ln(1 + abs(Amount)) AS x FROM (SELECT *, row_number() OVER (PARTITION BY Class ORDER BY md5('42:' || row_id), row_id) AS rank FROM ev WHERE Amount IS NOT NULL) b
JOIN (SELECT Class, sum(n) OVER (ORDER BY Class) - n AS start FROM (SELECT Class, count(*) AS n FROM ev WHERE Amount IS NOT NULL GROUP BY Class)) c ON b.Class = c.Class),
s AS (SELECT o.fold, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest([1, 2, 3, 4, 5]) AS fold) o JOIN f ON f.fold <> o.fold GROUP BY o.fold),
z AS (SELECT o.fold, f.fold = o.fold AS evaluated, Class, round(abs((x - m) / s), 9) AS score FROM f, s o),
t AS (SELECT fold, quantile_cont(score, 0.95) AS threshold FROM z WHERE NOT evaluated GROUP BY fold),
a AS (SELECT z.fold, Class, score, score >= threshold AS p FROM z JOIN t ON z.fold = t.fold WHERE evaluated),
c AS (SELECT fold, {CONFUSION} FROM a GROUP BY fold), m AS (SELECT fold, TP, FP, FN, {DERIVED} FROM c), {AP.format(by='fold', score='score', label='Class', src='a').replace('c AS', 'cc AS').replace('FROM c ', 'FROM cc ')}
SELECT m.fold, TP, FP, FN, precision, recall, f1, round(average_precision, 6) AS average_precision FROM m JOIN ap ON m.fold = ap.fold"""


@query(NESTED)
def nested_cv_center_distance(spark, d):
    """Folds, scaling on training, distance from the centre, threshold from training, metrics on the rest."""
    e = materialize(sampling.stratified_folds(events(spark, d).where("Amount is not null"), "Class", 5).withColumn("x", F.log1p(F.abs("Amount"))), "folds")
    o = e.select("*", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("outer_fold"))
    s = o.where("fold <> outer_fold").groupBy("outer_fold").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = o.join(s, "outer_fold").withColumn("score", F.round(F.abs((F.col("x") - F.col("m")) / F.col("s")), 9))
    t = evaluation.quantile_threshold(z.where("fold <> outer_fold"), "score", 0.05, ["outer_fold"])
    a = z.where("fold = outer_fold").drop("outer_fold").join(t.withColumnRenamed("outer_fold", "fold"), "fold").withColumn("p", (F.col("score") >= F.col("threshold")).cast("int"))
    a = materialize(a, "alerts")
    m = evaluation.confusion(a, "p", "Class", ["fold"]).drop("TN").join(evaluation.average_precision(a, "score", "Class", ["fold"]).drop("positives"), "fold")
    return rounded(m, "precision", "recall", "f1", "average_precision")


# --- neighbours ------------------------------------------------------------------------

DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
KNN = f"""{VECTORS}, d AS MATERIALIZED (SELECT a.id AS query, b.id AS id, list_distance(a.v, b.v) AS distance FROM vec a, vec b),
nn AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM d),
nx AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM d WHERE query <> id)"""


@query(f"WITH {KNN} SELECT query, rank, id, round(distance, 6) AS distance FROM nn WHERE rank <= 6")
def knn(spark, d):
    v = vectors(spark, d)
    return rounded(neighbors.knn(v, v, 6, include_self=True), "distance")


@query(f"WITH {KNN} SELECT query, rank, id, round(distance, 6) AS distance FROM nx WHERE rank <= 5")
def knn_train_excluding_self(spark, d):
    v = vectors(spark, d)
    return rounded(neighbors.knn(v, v, 5), "distance")


@query(f"WITH {KNN} SELECT query AS id, round(distance, 6) AS core FROM nn WHERE rank = 5")
def core_distance(spark, d):
    v = vectors(spark, d)
    return rounded(neighbors.core_distance(neighbors.knn(v, v, 5, include_self=True), 5), "core")


@query(f"WITH {KNN}, c AS (SELECT query AS id, distance AS core FROM nn WHERE rank = 5) SELECT n.query, n.rank, n.id, round(n.distance, 6) AS distance, round(greatest(a.core, b.core, n.distance), 6) AS reach FROM nn n JOIN c a ON n.query = a.id JOIN c b ON n.id = b.id WHERE n.rank <= 5")
def mutual_reachability(spark, d):
    v = vectors(spark, d)
    n = neighbors.knn(v, v, 5, include_self=True)
    return rounded(neighbors.mutual_reachability(n, neighbors.core_distance(n, 5)), "distance", "reach")


@query(f"WITH {KNN} SELECT v.label, count(*) AS n, round(median(distance), 6) AS median FROM nx JOIN vec v ON nx.query = v.id WHERE rank = 20 GROUP BY v.label")
def kth_neighbor_density_by_class(spark, d):
    v = vectors(spark, d)
    k = neighbors.core_distance(neighbors.knn(v, v, 20), 20).join(v.select("id", "label"), "id")
    middle = evaluation.exact_quantiles(k, "core", [0.5], ["label"]).select("label", F.col("quantiles")[0].alias("median"))
    return rounded(k.groupBy("label").agg(F.count("*").alias("n")).join(middle, "label"), "median")


@query(f"""WITH {VECTORS}, r AS (SELECT a.id, b.label, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS k FROM vec a, vec b WHERE a.label >= 5 AND b.label < 5)
SELECT id, CASE WHEN distance <= 1.2 THEN label ELSE -1 END AS label, round(distance, 6) AS distance FROM r WHERE k = 1""")
def radius_nearest_core(spark, d):
    v = vectors(spark, d)
    return rounded(neighbors.nearest_core(v.where("label < 5"), v.where("label >= 5"), 1.2), "distance")


FINITE = "abs({c}) < 1e300"
PAIRED = "tr AS (SELECT run_id, score, train AS v FROM scorepair WHERE isfinite(train) AND run_id IS NOT NULL AND score IS NOT NULL), evl AS (SELECT run_id, score, row_id, evaluated AS v FROM scorepair WHERE isfinite(evaluated) AND run_id IS NOT NULL AND score IS NOT NULL)"


@query(f"""WITH {PAIRED}, u AS (SELECT run_id, score, v, count(*) AS n FROM tr GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY run_id, score ORDER BY v) AS cum, sum(n) OVER (PARTITION BY run_id, score) AS total FROM u)
SELECT e.run_id, e.score, e.row_id, round(CASE WHEN t.n IS NULL THEN NULL ELSE coalesce(c.cum, 0) / t.n END, 6) AS percentile_rank FROM evl e
LEFT JOIN (SELECT run_id, score, sum(n) AS n FROM u GROUP BY ALL) t ON e.run_id = t.run_id AND e.score = t.score ASOF LEFT JOIN c ON e.run_id = c.run_id AND e.score = c.score AND e.v >= c.v""")
def percentile_rank(spark, d):
    s = table(spark, d, "scorepair").where("run_id is not null and score is not null")
    r = s.where("abs(train) < 1e300").select("run_id", "score", F.col("train").alias("v"))
    v = s.where("abs(evaluated) < 1e300").select("run_id", "score", "row_id", F.col("evaluated").alias("v"))
    return rounded(scores.percentile_rank(r, v, "v", ["run_id", "score"]).select("run_id", "score", "row_id", "percentile_rank"), "percentile_rank")


@query(f"WITH {BASE} SELECT row_id, round((cume_dist() OVER (ORDER BY score) + cume_dist() OVER (ORDER BY Amount)) / 2, 6) AS ensemble FROM base")
def ensemble_rank_score(spark, d):
    b = base(spark, d).select("row_id", "score", "Amount")
    x = scores.percentile_rank(b.select("score"), b, "score", name="a")
    x = scores.percentile_rank(b.select("Amount"), x, "Amount", name="b")
    return rounded(scores.ensemble(x, ["a", "b"], "ensemble").select("row_id", "ensemble"), "ensemble")


@query(f"WITH {KNN} SELECT query AS id, round(cume_dist() OVER (ORDER BY round(distance, 9)), 6) AS degree FROM nx WHERE rank = 5")
def knn_anomaly_degree(spark, d):
    v = vectors(spark, d)
    k = rounded(neighbors.core_distance(neighbors.knn(v, v, 5), 5), "core", digits=9)
    return rounded(scores.percentile_rank(k.select("core"), k, "core", name="degree").select("id", "degree"), "degree")


# --- statistics --------------------------------------------------------------------------

LONG = f"{BASE}, l AS (SELECT Class, unnest({V_COLUMNS + ['Amount']}) AS feature, unnest([{', '.join(V_COLUMNS + ['Amount'])}]) AS value FROM base)"


@query(f"""WITH {LONG}, g AS (SELECT feature, value, count_if(Class = 0) AS a, count_if(Class = 1) AS b FROM l GROUP BY ALL), c AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER f AS na, sum(b) OVER f AS nb FROM g WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature))
SELECT feature, round(max(abs(ca / na - cb / nb)), 6) AS d FROM c GROUP BY feature""")
def ks_two_sample(spark, d):
    return rounded(statistics.ks_two_sample(base(spark, d), [*V_COLUMNS, "Amount"], "Class").select("feature", "d"), "d")


@query()
def ks_p_values(spark, d):
    """Approximate p-values of the two-sample comparison."""
    return rounded(statistics.ks_two_sample(base(spark, d), [*V_COLUMNS, "Amount"], "Class").select("feature", "p_value"), "p_value")


@query(f"WITH {BASE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM base" for a, b in PAIRS if a != b))
def correlation_matrix(spark, d):
    c = statistics.correlations(base(spark, d), V_COLUMNS)
    return rounded(c.where(F.substring("a", 2, 2).cast("int") < F.substring("b", 2, 2).cast("int")), "r")


@query(f"WITH {BASE}, r AS (" + " UNION ALL ".join(f"SELECT corr({a}, {b}) AS r FROM base" for a, b in PAIRS if a != b) + ") SELECT round(max(abs(r)), 6) AS most, round(avg(abs(r)), 6) AS mean FROM r")
def off_diagonal_corr(spark, d):
    c = statistics.correlations(base(spark, d), V_COLUMNS).where("a <> b")
    return rounded(c.agg(F.max(F.abs("r")).alias("most"), F.avg(F.abs("r")).alias("mean")), "most", "mean")


SPEARMAN = "SELECT '{name}' AS regime, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM (SELECT (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2) AS ra, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2) AS rb FROM (SELECT dbcv_score AS a, auprc AS b FROM hdbscan_grid_results_by_fold WHERE dbcv_score IS NOT NULL AND auprc IS NOT NULL {where}))"


@query(SPEARMAN.format(name="all", where="") + " UNION ALL " + SPEARMAN.format(name="low", where="AND dbcv_score < 0.5"))
def spearman(spark, d):
    h = history(spark, d)
    x = statistics.spearman(h, "dbcv_score", "auprc").select(F.lit("all").alias("regime"), "n", "rho")
    return rounded(x.unionByName(statistics.spearman(h.where("dbcv_score < 0.5"), "dbcv_score", "auprc").select(F.lit("low").alias("regime"), "n", "rho")), "rho")


@query(f"""WITH {LONG}, b AS (SELECT Class, feature, s AS direction, value * s AS value FROM l, (SELECT unnest([1, -1]) AS s)), {AP.format(by='feature, direction', score='value', label='Class', src='b')},
m AS (SELECT feature, max(round(average_precision, 9)) AS a FROM ap GROUP BY feature) SELECT ap.feature, round(any_value(m.a), 6) AS average_precision, CAST(max(direction) AS INTEGER) AS direction, round(any_value(m.a) / (SELECT avg(CAST(Class = 1 AS INTEGER)) FROM base), 4) AS lift
FROM ap JOIN m ON ap.feature = m.feature AND round(average_precision, 9) = m.a GROUP BY ap.feature""")
def discriminative_power(spark, d):
    x = statistics.discriminative_power(base(spark, d), [*V_COLUMNS, "Amount"], "Class")
    return x.select("feature", F.round("average_precision", 6).alias("average_precision"), "direction", F.round("lift", 4).alias("lift"))


@query(f"WITH {BASE} SELECT CAST(floor((Time % 86400) / 3600 / 3) * 3 AS INTEGER) AS band, count(*) AS n, round(10000 * avg(CAST(Class = 1 AS INTEGER)), 6) AS per_10000 FROM base GROUP BY 1")
def hour_band_rate(spark, d):
    b = base(spark, d).groupBy((F.floor(features.hour() / 3) * 3).cast("int").alias("band"))
    return rounded(b.agg(F.count("*").alias("n"), (10000 * F.avg((F.col("Class") == 1).cast("int"))).alias("per_10000")), "per_10000")


@query(f"""WITH {BASE}, g AS (SELECT Class, CAST(least(floor((ln(1 + Amount) - 0) / 0.5), 23) AS INTEGER) AS bin, count(*) AS n FROM base WHERE ln(1 + Amount) BETWEEN 0 AND 12 GROUP BY ALL) SELECT Class, bin, n, round(n / sum(n) OVER (PARTITION BY Class), 6) AS share FROM g""")
def class_histogram(spark, d):
    return rounded(statistics.histogram(base(spark, d).withColumn("x", F.log1p("Amount")), "x", "Class", 0, 12, 24), "share")


@query(f"""WITH {BASE}, q AS (SELECT Class, quantile_cont(Amount, [0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1]) AS q FROM base GROUP BY Class)
SELECT Class, unnest([0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100]) AS percent, round(unnest(q), 6) AS amount FROM q""")
def quantile_curve(spark, d):
    p = [0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100]
    q = evaluation.exact_quantiles(base(spark, d), "Amount", [i / 100 for i in p], ["Class"]).withColumnRenamed("quantiles", "q")
    z = q.select("Class", F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in p]).alias("percent"), F.col("q").alias("amount"))).alias("z"))
    return rounded(z.select("Class", F.col("z")["percent"].alias("percent"), F.col("z")["amount"].alias("amount")), "amount")


GRID = [i / 2 for i in range(21)]


@query(f"""WITH {BASE}, b AS (SELECT Class, ln(1 + Amount) AS v FROM base), s AS (SELECT Class, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM b GROUP BY Class)
SELECT b.Class, x, round(sum(exp(-pow((x - v) / h, 2) / 2) / sqrt(2 * pi())) / any_value(n) / any_value(h), 6) AS density FROM b JOIN s ON b.Class = s.Class, (SELECT unnest({GRID}::DOUBLE[]) AS x) GROUP BY b.Class, x""")
def kde_curve(spark, d):
    return rounded(statistics.kde(base(spark, d).withColumn("x0", F.log1p("Amount")), "x0", "Class", GRID), "density")


@query(f"WITH {BASE} SELECT feature, r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, Class), 6) AS r FROM base" for c in V_COLUMNS) + ") ORDER BY abs(r) DESC, feature LIMIT 3")
def top_components(spark, d):
    c = statistics.correlations(base(spark, d), [*V_COLUMNS, "Class"]).where("a <> 'Class' and b = 'Class'")
    return rounded(c.select(F.col("a").alias("feature"), "r"), "r").orderBy(F.desc(F.abs("r")), "feature").limit(3)


@query(f"WITH {BASE} SELECT Class, count(*) AS n, round(median(Amount), 6) AS median, round(avg(Amount), 6) AS mean, max(Amount) AS most FROM base GROUP BY Class")
def class_location_stats(spark, d):
    b = base(spark, d).select("Class", "Amount")
    middle = evaluation.exact_quantiles(b, "Amount", [0.5], ["Class"]).select("Class", F.col("quantiles")[0].alias("median"))
    return rounded(b.groupBy("Class").agg(F.count("*").alias("n"), F.avg("Amount").alias("mean"), F.max("Amount").alias("most")).join(middle, "Class"), "median", "mean")


STEP = 1.0
PLANE = [(float(a), float(b)) for a in range(-12, 7) for b in range(-12, 7)]


@query(f"""WITH {BASE}, s AS (SELECT Class, count(*) AS n, var_samp(V14) AS xx, var_samp(V10) AS yy, covar_samp(V14, V10) AS xy, pow(count(*), -1 / 3) AS h2 FROM base GROUP BY Class),
p AS (SELECT px, py FROM (SELECT unnest(range(-12, 7))::DOUBLE AS px), (SELECT unnest(range(-12, 7))::DOUBLE AS py)),
k AS (SELECT b.Class, px, py, sum(exp(-(yy * pow(px - V14, 2) - 2 * xy * (px - V14) * (py - V10) + xx * pow(py - V10, 2)) / (xx * yy - xy * xy) / h2 / 2)) / (2 * pi() * any_value(n) * any_value(h2) * sqrt(any_value(xx) * any_value(yy) - any_value(xy) * any_value(xy))) AS density FROM base b JOIN s ON b.Class = s.Class, p GROUP BY ALL),
l AS (SELECT *, sum(density) OVER (PARTITION BY Class ORDER BY density DESC, px, py ROWS UNBOUNDED PRECEDING) / sum(density) OVER (PARTITION BY Class) AS level FROM k),
a AS (SELECT round(V14) AS px, round(V10) AS py, count(*) AS n FROM base GROUP BY ALL)
SELECT Class, region, count(*) FILTER (WHERE level <= region) AS points, round(coalesce(sum(a.n) FILTER (WHERE level <= region), 0) / (SELECT count(*) FROM base), 6) AS share
FROM l LEFT JOIN a ON l.px = a.px AND l.py = a.py, (SELECT unnest([0.5, 0.8, 0.95]) AS region) GROUP BY ALL""")
def density_region_share(spark, d):
    """Share of all rows in each class's regions of highest density of V14 and V10."""
    b = base(spark, d).select("Class", "V14", "V10")
    levels = statistics.density_levels(materialize(statistics.kde_plane(b, "V14", "V10", "Class", PLANE), "plane"), "Class")
    return rounded(statistics.region_share(b.select(F.col("V14").alias("px"), F.col("V10").alias("py")), levels, "Class", STEP, [0.5, 0.8, 0.95]), "share")


@query()
def spearman_p_value(spark, d):
    """Rank correlation of validity and average precision with its p-value."""
    n, rho = statistics.spearman(history(spark, d), "dbcv_score", "auprc").first()
    return rounded(spark.createDataFrame([(n, rho, statistics.spearman_p(rho, n))], "n bigint, rho double, p_value double"), "rho", "p_value")


# --- density, validity, condensed trees ---------------------------------------------------------

MU = 5
ROUNDS = 9
CLOSURE = f"""{VECTORS}, d AS MATERIALIZED (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM vec a, vec b),
core AS MATERIALIZED (SELECT i, d AS core FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM d) WHERE r = {MU}),
r0 AS MATERIALIZED (SELECT d.i, d.j, CASE WHEN d.i = d.j THEN 0 ELSE greatest(d.d, a.core, b.core) END AS w FROM d JOIN core a ON d.i = a.i JOIN core b ON d.j = b.i),
""" + ",\n".join(f"r{k + 1} AS MATERIALIZED (SELECT x.i, y.j, min(greatest(x.w, y.w)) AS w FROM r{k} x JOIN r{k} y ON x.j = y.i GROUP BY x.i, y.j)" for k in range(ROUNDS)) + f",\ndc AS (SELECT i, j, w FROM r{ROUNDS})"


def _one_group(df: DataFrame, run, schema: str, by: str | None = None) -> DataFrame:
    """Run a kernel over all points of a group; the group must fit a task (quadratic kernels)."""

    def kernel(t: pa.Table) -> pa.Table:
        x = t.sort_by("id")
        return run(x.column("id").to_numpy(), np.array(x.column("vector").to_pylist(), float), x.column("label").to_numpy())

    return df.withColumn("g", F.lit(0) if by is None else F.col(by)).groupBy("g").applyInArrow(kernel, schema)


@query(f"WITH {CLOSURE} SELECT i AS id, round(avg(w) FILTER (WHERE i <> j), 6) AS mean, round(min(w) FILTER (WHERE i <> j), 6) AS least FROM dc GROUP BY i")
def dc_distance(spark, d):
    """Mean and smallest density-connectivity distance of every vector to all others."""

    def run(ids, x, label):
        tree, _ = density.density_tree(x, MU)
        total, least = tree.to_groups(np.zeros(len(x), int), 1)
        return pa.table({"id": ids, "mean": total[:, 0] / max(len(x) - 1, 1), "least": least[:, 0]})

    return rounded(_one_group(vectors(spark, d), run, "id bigint, mean double, least double"), "mean", "least")


@query()
def dbscan_core_components(spark, d):
    """Core vectors by connected component, labelled by the smallest member."""
    return _one_group(vectors(spark, d), lambda ids, x, label: pa.table({"id": ids, "component": np.where((c := density.components(x, 0.9, MU)) >= 0, ids[c], -1)}), "id bigint, component bigint")


DISCO = f"""WITH {CLOSURE}, lab AS (SELECT id, CASE WHEN label = 9 THEN -1 ELSE label END AS l FROM vec),
pc AS (SELECT dc.i, x.l AS own, y.l AS c, sum(w) AS s, min(w) AS m, count(*) AS n FROM dc JOIN lab x ON dc.i = x.id JOIN lab y ON dc.j = y.id GROUP BY ALL),
wide AS (SELECT l AS c, max(core) AS wide FROM core JOIN lab ON core.i = lab.id WHERE l >= 0 GROUP BY l),
ab AS (SELECT i, max(CASE WHEN c = own THEN s / (n - 1) END) AS a, min(CASE WHEN c <> own AND c >= 0 THEN s / n END) AS b FROM pc WHERE own >= 0 GROUP BY i)
SELECT i AS id, round((b - a) / greatest(a, b), 6) + 0 AS disco FROM ab
UNION ALL SELECT pc.i, round(min(least((core - wide) / greatest(core, wide), (m - wide) / greatest(m, wide))), 6) + 0 FROM pc JOIN wide ON pc.c = wide.c JOIN core ON pc.i = core.i WHERE own = -1 GROUP BY pc.i"""


@query(DISCO)
def disco_samples(spark, d):
    """DISCO score of every vector under its label, label 9 being noise."""
    return rounded(_one_group(vectors(spark, d), lambda ids, x, label: pa.table({"id": ids, "disco": validity.disco_samples(x, np.where(label == 9, -1, label), MU)}), "id bigint, disco double"), "disco")


@query()
def dbscan_labels(spark, d):
    """DBSCAN of every vector: components of core vectors, border vectors to their nearest core, -1 elsewhere."""

    def run(ids, x, label):
        found, core = density.dbscan(x, 0.9, MU)
        return pa.table({"id": ids, "cluster": np.where(found >= 0, ids[found], -1), "core": core})

    return _one_group(vectors(spark, d), run, "id bigint, cluster bigint, core boolean")


@query()
def dbscan_grid(spark, d):
    """A grid of radius and density with noise as alert, label 9 being the positives."""
    grid = experiment.grid(spark, {"eps": [0.8, 0.9, 1.0], "min_samples": [5, 10]}).select("combo_id", F.col("eps").cast("double"), F.col("min_samples").cast("int"))
    each = [r.asDict() for r in grid.collect()]

    def kernel(t: pa.Table) -> pa.Table:
        x = np.array(t.column("vector").to_pylist(), float)
        c = t.column("combo")[0].as_py()
        label, _ = density.dbscan(x, c["eps"], c["min_samples"])
        return pa.table({"combo_id": np.full(len(x), c["combo_id"], np.int32), "eps": np.full(len(x), c["eps"]), "min_samples": np.full(len(x), c["min_samples"], np.int32), "p": (label < 0).astype(np.int32), "Class": (t.column("label").to_numpy() == 9).astype(np.int32)})

    combos = F.explode(F.array(*[F.struct(*[F.lit(c[k]).alias(k) for k in ("combo_id", "eps", "min_samples")]) for c in each])).alias("combo")
    x = vectors(spark, d).select("id", "vector", "label", combos).groupBy("combo").applyInArrow(kernel, "combo_id int, eps double, min_samples int, p int, Class int")
    return rounded(evaluation.confusion(x, "p", "Class", ["combo_id", "eps", "min_samples"]), "precision", "recall", "f1")


@query()
def kmeans_partition(spark, d):
    """Vectors in ten clusters by k-means, a partition to measure validity on."""
    v = vectors(spark, d).withColumn("features", array_to_vector("vector"))
    return KMeans(k=10, seed=42, maxIter=20).fit(v).transform(v).select("id", F.col("prediction").alias("cluster"))


@query()
def disco_score(spark, d):
    """Mean DISCO score."""
    return rounded(disco_samples(spark, d).agg(F.avg("disco").alias("disco")), "disco")


@query()
def dbcv_score(spark, d):
    """DBCV of the vectors' labels."""
    return rounded(_one_group(vectors(spark, d), lambda ids, x, label: pa.table({"dbcv": [validity.dbcv_score(x, np.where(label == 9, -1, label))]}), "dbcv double"), "dbcv")


@query()
def hdbscan_labels(spark, d):
    """HDBSCAN* labels, membership and GLOSH of every vector."""

    def run(ids, x, label):
        found, member, rows = density.hdbscan(x, 10, MU)
        p, c, l, _ = (np.array(v) for v in zip(*rows))
        return pa.table({"id": ids, "cluster": found.astype(np.int64), "membership": member, "glosh": scores.glosh_train(p, c, l)})

    return rounded(_one_group(vectors(spark, d), run, "id bigint, cluster bigint, membership double, glosh double"), "membership", "glosh")


@query()
def hdbscan_glosh_degree(spark, d):
    """Mean percentile rank of the 5th-neighbour distance and of GLOSH."""

    def run(ids, x, label):
        _, _, rows = density.hdbscan(x, 10, MU)
        p, c, l, _ = (np.array(v) for v in zip(*rows))
        far = density.core_distances(x, MU + 1)
        g = scores.glosh_train(p, c, l)
        return pa.table({"id": ids, "degree": scores.degree_score(far, far, g, g)[0]})

    return rounded(_one_group(vectors(spark, d), run, "id bigint, degree double"), "degree")


# Trees over the embeddings: the root is 1 000 000, two clusters by parity of the label, below them one per label; label 9 leaves at the root.
TREE_SQL = """tree(parent, child, lam) AS (SELECT CASE WHEN label = 9 THEN 1000000 ELSE 1000010 + label END, id, CASE WHEN label = 9 THEN 0.1 + id % 7 / 100 ELSE 1 + id * 37 % 101 / 10 END FROM vec
UNION ALL SELECT DISTINCT 1000001 + label % 2, 1000010 + label, 0.5 + 0.05 * label FROM vec WHERE label < 9 UNION ALL SELECT DISTINCT 1000000, 1000001 + label % 2, 0.25 FROM vec WHERE label < 9),
up(cluster, below) AS (SELECT DISTINCT parent, parent FROM tree UNION SELECT up.cluster, tree.child FROM up JOIN tree ON tree.parent = up.below WHERE tree.child >= 1000000),
top AS (SELECT cluster, CAST(max(lam) AS DOUBLE) AS lambda_max FROM up JOIN tree ON tree.parent = up.below AND tree.child < 1000000 GROUP BY cluster)"""


def _clusters(v):
    label, parity = F.col("label") + 1000010, F.col("label") % 2 + 1000001
    a = v.where("label < 9").select(parity.cast("bigint").alias("parent"), label.cast("bigint").alias("child"), (0.5 + 0.05 * F.col("label")).alias("lam")).distinct()
    return a.unionByName(v.where("label < 9").select(F.lit(1000000).cast("bigint").alias("parent"), parity.cast("bigint").alias("child"), F.lit(0.25).alias("lam")).distinct())


def _tree(spark, d):
    v = vectors(spark, d)
    noise = F.col("label") == 9
    own = v.select(F.when(noise, 1000000).otherwise(F.col("label") + 1000010).cast("bigint").alias("parent"), F.col("id").alias("child"), F.when(noise, 0.1 + F.col("id") % 7 / 100).otherwise(1 + F.col("id") * 37 % 101 / 10).alias("lam"))
    return own.unionByName(_clusters(v))


@query(f"WITH RECURSIVE {VECTORS}, {TREE_SQL} SELECT cluster, round(lambda_max, 6) AS lambda_max FROM top")
def lambda_max(spark, d):
    """The largest lambda below each cluster of a condensed tree."""
    return rounded(scores.lambda_max_rows(_tree(spark, d)), "lambda_max")


@query(f"WITH RECURSIVE {VECTORS}, {TREE_SQL} SELECT child AS point, round(CASE WHEN lambda_max = 0 THEN 0 ELSE 1 - lam / lambda_max END, 6) AS glosh FROM tree JOIN top ON tree.parent = top.cluster WHERE child < 1000000")
def glosh_train(spark, d):
    """GLOSH of every point of a condensed tree."""
    return rounded(scores.glosh_rows(_tree(spark, d)), "glosh")


@query(f"""WITH RECURSIVE {VECTORS}, d AS MATERIALIZED (SELECT a.id AS query, a.label AS q_label, b.id AS id, list_distance(a.v, b.v) AS distance FROM vec a, vec b WHERE b.label < 9),
nn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d), core AS (SELECT query AS id, distance AS core FROM nn WHERE rank = 5 AND q_label < 9), own AS (SELECT query, distance AS own FROM nn WHERE rank = 3 AND q_label = 9),
tree(parent, child, lam) AS (SELECT 1000010 + label, id, 1 / core FROM vec JOIN core USING (id) UNION ALL SELECT DISTINCT 1000001 + label % 2, 1000010 + label, 0.5 + 0.05 * label FROM vec WHERE label < 9 UNION ALL SELECT DISTINCT 1000000, 1000001 + label % 2, 0.25 FROM vec WHERE label < 9),
up(cluster, ancestor, steps) AS (SELECT DISTINCT parent, parent, 0 FROM tree UNION SELECT up.cluster, tree.parent, steps + 1 FROM up JOIN tree ON tree.child = up.ancestor),
top AS (SELECT ancestor AS cluster, max(lam) AS lambda_max FROM up JOIN tree ON tree.parent = up.cluster AND tree.child < 1000000 GROUP BY ancestor),
l AS (SELECT n.query, rank, least(1 / greatest(distance, core, own), lam) AS lam, parent FROM nn n JOIN core USING (id) JOIN own USING (query) JOIN tree ON tree.child = n.id WHERE rank <= 4 AND q_label = 9),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query ORDER BY lam DESC, rank) = 1),
c AS (SELECT b.query, b.lam, up.ancestor AS cluster FROM b JOIN up ON up.cluster = b.parent LEFT JOIN tree t ON t.child = up.ancestor WHERE coalesce(t.lam, 0) <= b.lam QUALIFY row_number() OVER (PARTITION BY b.query ORDER BY steps) = 1)
SELECT query, cluster, round(1 - lam / lambda_max, 6) AS glosh FROM c JOIN top USING (cluster)""")
def glosh_new_points(spark, d):
    """GLOSH of the vectors of label 9 by their neighbours in a tree of the others."""
    v = vectors(spark, d)
    old, new = v.where("label < 9"), v.where("label = 9")
    core = materialize(neighbors.core_distance(neighbors.knn(old, old, 5, include_self=True), 5), "core")
    near = materialize(neighbors.knn(old, new, 4), "near")
    own = old.join(core, "id").select((F.col("label") + 1000010).cast("bigint").alias("parent"), F.col("id").alias("child"), (1 / F.col("core")).alias("lam"))
    return rounded(scores.glosh_new_rows(own.unionByName(_clusters(v)), near, core, neighbors.core_distance(near, 3)), "glosh")


# --- grids and histories -------------------------------------------------------------------------

H = "h AS (SELECT * FROM hdbscan_grid_results_by_fold WHERE combo_id IS NOT NULL AND fold IS NOT NULL)"
TIES = "combo_id, trial_id, logged_at, auprc DESC"
WINNERS = f"{H}, w AS (SELECT run_id, fold, combo_id, dbcv_score, auprc FROM (SELECT *, row_number() OVER (PARTITION BY run_id, fold ORDER BY dbcv_score DESC NULLS LAST, {TIES}) AS place FROM h) WHERE place = 1)"


def _history(spark, d):
    return history(spark, d).where("combo_id is not null and fold is not null")


def _winners(spark, d):
    return experiment.best_per_fold(_history(spark, d), "dbcv_score", ["run_id"], ["combo_id", "trial_id", "logged_at", F.desc("auprc")]).select("run_id", "fold", "combo_id", "dbcv_score", "auprc")


@query("SELECT CAST(27 * ia + 9 * ib + 3 * ic + ig AS INTEGER) AS combo_id, a AS n_estimators, b AS max_depth, c AS learning_rate, g AS gamma FROM (SELECT unnest(['100', '200', '300']) AS a, unnest([0, 1, 2]) AS ia), (SELECT unnest(['3', '6', '9']) AS b, unnest([0, 1, 2]) AS ib), (SELECT unnest(['0.01', '0.1', '0.2']) AS c, unnest([0, 1, 2]) AS ic), (SELECT unnest(['0', '0.5', '1']) AS g, unnest([0, 1, 2]) AS ig)")
def param_grid(spark, d):
    return experiment.grid(spark, experiment.BOOST_GRID)


@query("SELECT CAST(54 * ia + 18 * ib + 9 * ic + 3 * id + ie AS INTEGER) AS combo_id, a AS n_estimators, b AS max_features, c AS class_weight, d AS max_samples, e AS min_samples_leaf FROM (SELECT unnest(['100', '200', '300']) AS a, unnest([0, 1, 2]) AS ia), (SELECT unnest(['sqrt', '0.5', '0.7']) AS b, unnest([0, 1, 2]) AS ib), (SELECT unnest([NULL, 'balanced_subsample']) AS c, unnest([0, 1]) AS ic), (SELECT unnest(['0.1', '0.2', NULL]) AS d, unnest([0, 1, 2]) AS id), (SELECT unnest(['1', '2', '3']) AS e, unnest([0, 1, 2]) AS ie)")
def param_grid_forest(spark, d):
    return experiment.grid(spark, experiment.FOREST_GRID)


@query(f"WITH {WINNERS} SELECT * FROM w")
def best_per_fold(spark, d):
    return _winners(spark, d)


@query(f"WITH {WINNERS} SELECT run_id, fold, combo_id, dbcv_score, auprc FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dbcv_score DESC NULLS LAST, fold) AS place FROM w) WHERE place = 1")
def best_of_winners(spark, d):
    return experiment.best_of_winners(_winners(spark, d), "dbcv_score", ["run_id"])


SUMMARY = f"{H}, s AS (SELECT run_id, combo_id, round(avg(auprc), 8) AS auprc, round(avg(f1), 8) AS f1, round(avg(precision), 8) AS precision, round(avg(recall), 8) AS recall FROM h GROUP BY ALL)"


def _summary(spark, d):
    return rounded(experiment.summary(_history(spark, d), ["auprc", "f1", "precision", "recall"], ["run_id"]), "auprc", "f1", "precision", "recall", digits=8)


@query(f"WITH {SUMMARY} SELECT * FROM s")
def trial_summary(spark, d):
    return _summary(spark, d)


@query(f"WITH {SUMMARY} SELECT run_id, combo_id, auprc FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY auprc DESC NULLS LAST, combo_id) AS place FROM s) WHERE place = 1")
def best_by_mean(spark, d):
    w = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("auprc"), "combo_id")
    return _summary(spark, d).withColumn("place", F.row_number().over(w)).where("place = 1").select("run_id", "combo_id", "auprc")


# Only trials with a validity count as done, so that the history has gaps.
DONE = "p AS (SELECT DISTINCT run_id, fold, combo_id FROM h WHERE dbcv_score IS NOT NULL)"
GRID_ROWS = "g AS (SELECT f.fold, c.combo_id FROM (SELECT DISTINCT fold FROM h) f, (SELECT DISTINCT combo_id FROM h) c)"


@query(f"WITH {H}, {DONE}, {GRID_ROWS} SELECT r.run_id, g.fold, g.combo_id FROM (SELECT DISTINCT run_id FROM h) r, g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.run_id = r.run_id AND p.fold = g.fold AND p.combo_id = g.combo_id)")
def pending_combos(spark, d):
    """Combinations of the grid that a run has still to compute."""
    h = _history(spark, d).select("run_id", "fold", "combo_id", "dbcv_score")
    # The grid: a few values of fold and combo, gathered by name.
    folds_, combos = h.agg(F.sort_array(F.collect_set("fold")), F.sort_array(F.collect_set("combo_id"))).first()
    full = h.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(f) for f in folds_])).alias("fold"))
    full = full.select("run_id", "fold", F.explode(F.array(*[F.lit(c) for c in combos])).alias("combo_id"))
    return experiment.pending(full, h.where("dbcv_score is not null"), ("run_id", "fold", "combo_id"))


@query(f"WITH {H} SELECT run_id, fold, count(DISTINCT combo_id) AS combos FROM h GROUP BY ALL HAVING count(DISTINCT combo_id) = (SELECT count(DISTINCT combo_id) FROM h)")
def complete_folds(spark, d):
    h = _history(spark, d)
    return experiment.complete_folds(h, h.select("combo_id").distinct().count(), ["run_id"])


@query(f"WITH {BASE} SELECT CASE WHEN Class = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, count(*) AS n FROM base GROUP BY ALL")
def training_weights(spark, d):
    return base(spark, d).groupBy(models.training_weights("forest", "Class", 3.0).alias("weight")).agg(F.count("*").alias("n"))


def _outer(spark, d, kind, params):
    f = folds(spark, d)
    x = features.derive(f, excluded=["hour_sin", "hour_cos"], keep=["row_id", "Class", "fold"])
    columns = [c for c in x.columns if c not in ("row_id", "Class", "fold")]
    out = None
    for k in range(1, 6):
        scored = models.fit_predict(kind, params, x.where(F.col("fold") != k), x.where(F.col("fold") == k), columns).select("fold", "Class", "score", "predicted")
        out = scored if out is None else out.unionByName(scored)
    m = evaluation.confusion(out, "predicted", "Class", ["fold"]).join(evaluation.average_precision(out, "score", "Class", ["fold"]), "fold")
    return rounded(m, "precision", "recall", "f1", "average_precision")


@query()
def rf_outer_eval(spark, d):
    """A forest of the grid's first configuration on each outer fold."""
    return _outer(spark, d, "forest", experiment.clean_parameters(experiment.configurations(experiment.FOREST_GRID)[0]))


@query()
def gbt_outer_eval(spark, d):
    """A boosted model of the grid's first configuration on each outer fold."""
    return _outer(spark, d, "boost", experiment.clean_parameters(experiment.configurations(experiment.BOOST_GRID)[0]))


def _search(spark, d, kind, values):
    """The whole grid on the inner part of every outer fold: the next fold is its validation part."""
    f = folds(spark, d)
    x = features.derive(f, excluded=["hour_sin", "hour_cos"], keep=["row_id", "Class", "fold"])
    columns = [c for c in x.columns if c not in ("row_id", "Class", "fold")]
    x = x.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(1, 6)]))).where("own <> fold")
    x = x.withColumn("part", F.when(F.col("own") == F.pmod(F.col("fold"), F.lit(5)) + 1, "val").otherwise("train"))
    m = pipeline.supervised_search(x, experiment.configurations(values), kind, columns)
    return rounded(m, "precision", "recall", "f1", "average_precision")


# Hundreds of distributed fits: whole searches are run by name, not with the registered queries.
def rf_search(spark, d):
    """Every combination of the forest's grid on every inner fold."""
    return _search(spark, d, "forest", experiment.FOREST_GRID)


def gbt_search(spark, d):
    """Every combination of the boosted model's grid on every inner fold."""
    return _search(spark, d, "boost", experiment.BOOST_GRID)


VECTOR_RUN = experiment.RunConfig(distance="euclidean", alert_rate=0.1, extra_rates=(0.05, 0.2), extra_metrics=("dbcv",), min_cluster_size=(5, 10), min_samples=(5, 10))
TIMES = ("train_time_min", "val_time_min", "predict_time_min")


def _vector_folds(spark, d):
    """Vectors with two of five folds as validation and test part of each outer fold."""
    v = sampling.stratified_folds(vectors(spark, d).withColumn("Class", (F.col("label") == 9).cast("int")), "Class", 5, key="id")
    o = v.select("id", "vector", "Class", F.col("fold").alias("own"), F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("fold"))
    return o.select("fold", "id", "vector", "Class", F.when(F.col("own") == F.col("fold"), "test").when(F.pmod(F.col("own"), F.lit(5)) + 1 == F.col("fold"), "val").otherwise("train").alias("part"))


@query()
def inner_cycle(spark, d):
    """Every combination of the grid on every inner fold: clustering, validity, all scores, metrics at all rates."""
    return pipeline.inner_cycle(_vector_folds(spark, d).where("part <> 'test'"), VECTOR_RUN).drop(*TIMES)


@query()
def outer_cycle(spark, d):
    """The inner cycle's best configuration on every outer fold, with mean and deviation."""
    f = _vector_folds(spark, d)
    _, by_fold = pipeline.select_best(pipeline.inner_cycle(f.where("part <> 'test'"), VECTOR_RUN), VECTOR_RUN)
    params = pipeline.best_configuration(by_fold, VECTOR_RUN)
    return pipeline.with_summary(pipeline.outer_cycle(f.where("part <> 'val'"), params, VECTOR_RUN).drop(*TIMES))


RUN_FOLDS = f"""WITH {FOLDS}, o AS (SELECT f.*, outer_fold FROM folds f, (SELECT unnest([1, 2, 3, 4, 5]) AS outer_fold)),
u AS (SELECT DISTINCT outer_fold, {', '.join(V_COLUMNS)}, ln(1 + Amount) AS a FROM o WHERE fold <> outer_fold)"""


def _prepared(spark, d, distance):
    config = experiment.RunConfig(distance=distance)
    rows = folds(spark, d).withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])))
    return pipeline.prepare(rows.withColumn("part", F.when(F.col("own") == F.col("fold"), "test").otherwise("train")), config)


SQUARE = "aggregate(vector, 0D, (a, v) -> a + v * v)"


@query(RUN_FOLDS + f""", m AS (SELECT outer_fold, {', '.join(f'avg({c}) AS m_{c}' for c in V_COLUMNS)}, avg(a) AS m_a, stddev_pop(a) AS s_a FROM u GROUP BY outer_fold)
SELECT o.outer_fold AS fold, o.row_id AS id, round(sqrt({' + '.join(f'({c} - m_{c}) * ({c} - m_{c})' for c in V_COLUMNS)} + pow((ln(1 + Amount) - m_a) / s_a, 2)), 6) AS distance FROM o JOIN m ON o.outer_fold = m.outer_fold WHERE o.fold = o.outer_fold""")
def prepared_euclidean(spark, d):
    """Distance from the training centre of every evaluated row, features standardised and centred on each outer fold's training part."""
    return rounded(_prepared(spark, d, "euclidean").where("part = 'test'").select("fold", "id", F.sqrt(F.expr(SQUARE)).alias("distance")), "distance")


@query(RUN_FOLDS + " SELECT outer_fold AS fold, count(*) AS n, round(29.0 * (count(*) - 1) / count(*), 5) AS mean_square FROM u GROUP BY outer_fold")
def prepared_mahalanobis(spark, d):
    """Mean square of the whitened training rows: the number of features times (n - 1) / n."""
    x = _prepared(spark, d, "mahalanobis").where("part = 'train'")
    return rounded(x.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.expr(SQUARE)).alias("mean_square")), "mean_square", digits=5)


# --- reports -------------------------------------------------------------------------------------

CONFIG = "'mcs ' || min_cluster_size || ' | ms ' || min_samples"


def _config(spark, d):
    return history(spark, d).withColumn("config", F.concat(F.lit("mcs "), F.col("min_cluster_size").cast("string"), F.lit(" | ms "), F.col("min_samples").cast("string")))


@query("SELECT run_id, CAST(sum(TP) AS BIGINT) AS TP, CAST(sum(FP) AS BIGINT) AS FP, CAST(sum(FN) AS BIGINT) AS FN, CAST(sum(TP + FP) AS BIGINT) AS alerts FROM hdbscan_grid_results_by_fold GROUP BY run_id")
def alert_counts(spark, d):
    return history(spark, d).groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("TP", "FP", "FN")], F.sum(F.col("TP") + F.col("FP")).alias("alerts"))


WIDE = "w AS (SELECT run_id, fold, TP, FN, auprc AS f1, f1 * 0.5 AS \"f1_at_0.0008\", f1 AS \"f1_at_0.0017\", recall * 0.5 AS \"recall_at_0.0008\", recall AS \"recall_at_0.0017\" FROM hdbscan_grid_results_by_fold)"


def _wide(spark, d):
    return history(spark, d).select("run_id", "fold", "TP", "FN", F.col("auprc").alias("f1"), (F.col("f1") * 0.5).alias("f1_at_0p0008"), F.col("f1").alias("f1_at_0p0017"), (F.col("recall") * 0.5).alias("recall_at_0p0008"), F.col("recall").alias("recall_at_0p0017"))


@query(f"WITH {WIDE} SELECT run_id, '0p0008' AS rate, round(avg(\"f1_at_0.0008\"), 6) AS f1, round(avg(\"recall_at_0.0008\"), 6) AS recall FROM w GROUP BY run_id UNION ALL SELECT run_id, '0p0017', round(avg(\"f1_at_0.0017\"), 6), round(avg(\"recall_at_0.0017\"), 6) FROM w GROUP BY run_id")
def alert_curve(spark, d):
    return rounded(reports.alert_curve(_wide(spark, d), ["f1", "recall"], ["0p0008", "0p0017"], ["run_id"]), "f1", "recall")


@query(f"WITH {WIDE} SELECT run_id, round(avg(f1), 6) AS f1_at_main, round(avg(\"f1_at_0.0017\"), 6) AS f1 FROM w GROUP BY run_id")
def adopt_rate(spark, d):
    x = reports.adopt_rate(_wide(spark, d), ["f1"], "0p0017", "TP")
    return rounded(x.groupBy("run_id").agg(F.avg("f1_at_main").alias("f1_at_main"), F.avg("f1").alias("f1")), "f1_at_main", "f1")


@query(f"SELECT {CONFIG} AS config, " + ", ".join(f"round(avg(auprc) FILTER (WHERE fold = {k}), 6) AS fold_{k}" for k in range(1, 6)) + " FROM hdbscan_grid_results_by_fold WHERE min_cluster_size IS NOT NULL AND min_samples IS NOT NULL GROUP BY 1")
def metric_pivot(spark, d):
    p = _config(spark, d).where("config is not null").groupBy("config").pivot("fold", [1, 2, 3, 4, 5]).agg(F.avg("auprc"))
    return rounded(p.select("config", *[F.col(str(k)).alias(f"fold_{k}") for k in range(1, 6)]), *[f"fold_{k}" for k in range(1, 6)])


@query(f"SELECT {CONFIG} AS config, min(auprc) AS least, max(auprc) AS most, round(median(auprc), 8) AS median, round(avg(auprc), 8) AS mean, round(stddev_samp(auprc), 8) AS deviation, round(max(auprc) - min(auprc), 8) AS spread FROM hdbscan_grid_results_by_fold GROUP BY 1")
def spread_by_config(spark, d):
    return rounded(reports.spread(_config(spark, d), "auprc", ["config"]), "median", "mean", "deviation", "spread", digits=8)


@query("""WITH l AS (SELECT run_id, unnest(['auprc', 'f1']) AS metric, unnest([auprc, f1]) AS value FROM hdbscan_grid_results_by_fold), g AS (SELECT run_id, metric, avg(value) AS mean, stddev_samp(value) AS deviation FROM l GROUP BY ALL)
SELECT run_id, metric, round(mean, 6) AS mean, round(deviation, 6) AS deviation, coalesce(round(mean, 3) = max(round(mean, 3)) OVER (PARTITION BY metric), false) AS best FROM g""")
def mean_sd_best(spark, d):
    return rounded(reports.mean_sd_best(history(spark, d).select("run_id", "auprc", "f1"), ["auprc", "f1"], ["run_id"]), "mean", "deviation")


@query(f"WITH {SUMMARY} SELECT run_id, max(best) AS best, count_if(auprc >= best - 0.01 - 1e-12) AS near_best FROM (SELECT *, max(auprc) OVER (PARTITION BY run_id) AS best FROM s) GROUP BY run_id")
def supervised_selection(spark, d):
    return reports.within_of_best(_summary(spark, d), "auprc", ["run_id"])


@query("SELECT min_samples, round(avg(n_clusters), 6) AS clusters, round(avg(dbcv_score), 6) AS mean, max(dbcv_score) AS most, round(avg(auprc), 6) AS auprc FROM hdbscan_grid_results_by_fold GROUP BY min_samples")
def inner_cycle_table(spark, d):
    return rounded(history(spark, d).groupBy("min_samples").agg(F.avg("n_clusters").alias("clusters"), F.avg("dbcv_score").alias("mean"), F.max("dbcv_score").alias("most"), F.avg("auprc").alias("auprc")), "clusters", "mean", "auprc")


@query(f"""WITH g AS (SELECT run_id, {CONFIG} AS config, round(max(dbcv_score), 9) AS top, round(avg(dbcv_score), 9) AS mean FROM hdbscan_grid_results_by_fold GROUP BY ALL)
SELECT DISTINCT run_id, first_value(config) OVER (PARTITION BY run_id ORDER BY top DESC NULLS LAST, config) AS by_max, first_value(config) OVER (PARTITION BY run_id ORDER BY mean DESC NULLS LAST, config) AS by_mean FROM g""")
def winner_by_max_and_mean(spark, d):
    return reports.winners_by(_config(spark, d), "dbcv_score", "run_id", "config")


@query("SELECT 'trial' AS kind, CAST(fold AS VARCHAR) AS fold, count(*) AS n, round(avg(auprc), 6) AS auprc FROM hdbscan_grid_results_by_fold GROUP BY fold UNION ALL SELECT 'summary', 'mean', count(*), round(avg(auprc), 6) FROM hdbscan_grid_results_by_fold")
def outer_long_table(spark, d):
    h = history(spark, d)
    a = h.groupBy(F.col("fold").cast("string").alias("fold")).agg(F.count("*").alias("n"), F.avg("auprc").alias("auprc")).withColumn("kind", F.lit("trial"))
    b = h.agg(F.count("*").alias("n"), F.avg("auprc").alias("auprc")).withColumns({"fold": F.lit("mean"), "kind": F.lit("summary")})
    return rounded(a.unionByName(b).select("kind", "fold", "n", "auprc"), "auprc")


@query(f"""WITH g AS (SELECT run_id, {CONFIG} AS config, round(avg(auprc), 8) AS auprc FROM hdbscan_grid_results_by_fold GROUP BY ALL)
SELECT run_id, config, auprc, CAST(row_number() OVER (PARTITION BY run_id ORDER BY auprc DESC NULLS LAST, config) AS INTEGER) AS place FROM g WHERE config IS NOT NULL""")
def ranking_position(spark, d):
    """Every configuration's position in its run by mean average precision."""
    g = rounded(_config(spark, d).where("config is not null").groupBy("run_id", "config").agg(F.avg("auprc").alias("auprc")), "auprc", digits=8)
    return reports.position(g, "auprc", ["run_id"], ["config"])


@query("SELECT CAST(fold AS INTEGER) AS fold, replace(printf('%.3f', round(avg(auprc), 6)), '.', ',') AS auprc FROM hdbscan_grid_results_by_fold WHERE fold IS NOT NULL GROUP BY fold")
def report_texts(spark, d):
    """The folds' rows of a report that has a summary row too, numbers as text."""
    h = history(spark, d).where("fold is not null")
    rows = h.groupBy(F.col("fold").cast("string").alias("fold")).agg(F.avg("auprc").alias("auprc")).unionByName(h.agg(F.avg("auprc").alias("auprc")).withColumn("fold", F.lit("mean")))
    return reports.report_folds(rounded(rows, "auprc")).select("fold", reports.decimal_text("auprc").alias("auprc"))


@query(f"""WITH {SUMMARY}, b AS (SELECT *, max(auprc) OVER (PARTITION BY run_id) AS best FROM s), c AS (SELECT run_id, combo_id FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY auprc DESC NULLS LAST, combo_id) = 1)
SELECT b.run_id, b.combo_id, b.auprc, b.combo_id = c.combo_id AS chosen FROM b JOIN c ON b.run_id = c.run_id WHERE b.auprc >= best - 0.01 - 1e-12""")
def near_best_configurations(spark, d):
    """Configurations within 0.01 of their run's best, and which of them is chosen."""
    x = _summary(spark, d).select("run_id", "combo_id", "auprc")
    top = reports.position(x, "auprc", ["run_id"], ["combo_id"]).where("place = 1").select("run_id", F.col("combo_id").alias("first"), F.col("auprc").alias("best"))
    return x.join(top, "run_id").where(F.col("auprc") >= F.col("best") - 0.01 - 1e-12).select("run_id", "combo_id", "auprc", (F.col("combo_id") == F.col("first")).alias("chosen"))
