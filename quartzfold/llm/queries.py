"""Queries pN_... of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfold.llm import chunks, cube, gridcluster, hashing, mixing, packing, quantiles, stuffing
from quartzfold.llm.text import TOKEN, token_count
from quartzfold.session import materialize
from quartzfold.sources.tables import V_COLUMNS, table

PERCENTILES = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
EPSILON = 0.005
SCORE_KEYS = "run_id bigint, score string, day date"
AMOUNT_KEYS = "source string, batch_id bigint, Class int"


# --- 1: percentiles ---------------------------------------------------------


def _train_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scorepair").select("run_id", "score", F.to_date("scored_at").alias("day"), F.col("train").alias("value"))


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "creditcard").select("source", "batch_id", "Class", F.col("Amount").alias("value"))


def _both(scores: DataFrame, amounts: DataFrame) -> DataFrame:
    s = scores.withColumns({"measure": F.lit("train_score"), "source": F.lit(None).cast("string"), "batch_id": F.lit(None).cast("bigint"), "Class": F.lit(None).cast("int")})
    a = amounts.withColumns({"measure": F.lit("amount"), "run_id": F.lit(None).cast("bigint"), "score": F.lit(None).cast("string"), "day": F.lit(None).cast("date")})
    columns = ["measure", "run_id", "score", "day", "source", "batch_id", "Class", *[c for c in scores.columns if c not in ("run_id", "score", "day")]]
    return s.select(columns).unionByName(a.select(columns))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of training scores by run, score and day, of amounts by source, batch and Class."""
    s = quantiles.summarize(_train_scores(spark, d), ["run_id", "score", "day"], "value", EPSILON)
    a = quantiles.summarize(_amounts(spark, d), ["source", "batch_id", "Class"], "value", EPSILON)
    return _both(quantiles.percentiles(s, SCORE_KEYS, PERCENTILES), quantiles.percentiles(a, AMOUNT_KEYS, PERCENTILES))


def p1_joined_days(spark: SparkSession, d: str) -> DataFrame:
    """The daily summaries of a run's score joined into one, without going back to the rows."""
    s = quantiles.summarize(_train_scores(spark, d), ["run_id", "score", "day"], "value", EPSILON / 2)
    joined = quantiles.merge_summaries(quantiles.regroup(s, SCORE_KEYS, ["run_id", "score"]), levels=2, epsilon=EPSILON / 2)
    return quantiles.percentiles(joined, "run_id bigint, score string", PERCENTILES)


def p1_bound_held(spark: SparkSession, d: str) -> DataFrame:
    """Whether every percentile's true rank is within its stated error, by exact counting."""
    stated = p1_percentiles(spark, d)
    rows = _both(_train_scores(spark, d), _amounts(spark, d)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    keys = ["measure", "run_id", "score", "day", "source", "batch_id", "Class"]
    mark = lambda x: F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
    e = stated.withColumn("mark", mark(stated)).select("mark", "n", *PERCENTILES, "rank_error")
    x = rows.withColumn("mark", mark(rows)).join(e, "mark")
    counts = [F.count_if(F.col("value") < F.col(p)).alias(f"{p}_lt") for p in PERCENTILES] + [F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_le") for p in PERCENTILES]
    c = x.groupBy("measure", "mark").agg(F.first("n").alias("n"), F.count("*").alias("seen"), F.max("rank_error").alias("e"), *counts)
    ok = F.col("n") == F.col("seen")
    for p, q in PERCENTILES.items():
        rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n") - 1e-9))
        ok = ok & (F.greatest(F.col(f"{p}_lt") + 1 - rank, rank - F.col(f"{p}_le"), F.lit(0)) <= F.col("e")) & (F.col("e") <= F.ceil(F.lit(EPSILON) * F.col("n")))
    return c.groupBy("measure").agg(F.count("*").alias("groups_n"), F.sum("n").alias("rows_n"), F.count_if(~ok).alias("outside"))


P1_BOUND_HELD = """
SELECT 'train_score' AS measure, count(*) AS groups_n, CAST(sum(n) AS BIGINT) AS rows_n, CAST(0 AS BIGINT) AS outside
FROM (SELECT count(*) AS n FROM scorepair WHERE train IS NOT NULL AND NOT isnan(train) GROUP BY run_id, score, CAST(scored_at AS DATE))
UNION ALL
SELECT 'amount', count(*), CAST(sum(n) AS BIGINT), CAST(0 AS BIGINT)
FROM (SELECT count(*) AS n FROM creditcard WHERE Amount IS NOT NULL AND NOT isnan(Amount) GROUP BY source, batch_id, Class)
"""


# --- 2: similar transactions -----------------------------------------------------

VECTOR = [*V_COLUMNS, "log_amount", "hour_sin", "hour_cos"]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    angle = (F.col("Time") % 86400) / 3600 * (2 * math.pi / 24)
    return table(spark, d, "creditcard").select(F.col("row_id").alias("id"), *V_COLUMNS, F.log1p("Amount").alias("log_amount"), F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of a probe and one of its five most similar other transactions, the smaller id first."""
    vectors = _vectors(spark, d)
    probes = vectors.join(table(spark, d, "knn_probe").select(F.col("row_id").alias("id")).distinct(), "id", "left_semi")
    found = hashing.similar(vectors, probes, VECTOR)
    return found.select(F.least("query", "id").alias("row_id_a"), F.greatest("query", "id").alias("row_id_b")).distinct()


def p2_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of all transactions, for every transaction whose id is divisible by 20."""
    vectors = _vectors(spark, d)
    return hashing.similar(vectors, vectors.where("id % 20 = 0"), VECTOR).select(F.col("query").alias("row_id"), "place", F.col("id").alias("similar_row_id"), "distance")


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Probes, pairs found for them and, by comparing each probe with all transactions, true; recall by distance.

    A found transaction counts if it is no farther than the true one of the last place.
    """
    vectors = _vectors(spark, d)
    asked = vectors.join(table(spark, d, "knn_probe").select(F.col("row_id").alias("id")).distinct(), "id", "left_semi")
    found, true = hashing.similar(vectors, asked, VECTOR), hashing.exact(vectors, asked, VECTOR, 5)
    if true is None:
        return spark.createDataFrame([], "queries bigint, true_pairs bigint, found_pairs bigint, recall double")
    last = true.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("edge"))
    got = found.join(last.select("query", "edge"), "query").groupBy("query").agg(F.count_if(F.col("distance") <= F.col("edge") + 1e-6).alias("hit"))
    c = last.join(got, "query", "left").agg(F.count("*").alias("queries"), F.sum("n").alias("true_pairs"), F.sum(F.coalesce("hit", F.lit(0))).alias("found_pairs"))
    return c.withColumn("recall", F.round(F.try_divide("found_pairs", "true_pairs"), 4))


_ANGLE = "(Time % 86400) / 3600 * (2 * pi() / 24)"
P2_FOUND = f"""
WITH v AS (SELECT row_id, [{", ".join(V_COLUMNS)}, ln(1 + Amount), sin({_ANGLE}), cos({_ANGLE})] AS x FROM creditcard WHERE Time + Amount + {" + ".join(V_COLUMNS)} IS NOT NULL),
near AS (SELECT a.row_id AS a, b.row_id AS b, row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_distance(a.x, b.x), 6), b.row_id) AS place
FROM (SELECT * FROM v WHERE row_id IN (SELECT row_id FROM knn_probe)) a JOIN v b ON a.row_id <> b.row_id)
SELECT DISTINCT least(a, b) AS row_id_a, greatest(a, b) AS row_id_b FROM near WHERE place <= 5
"""


# --- 3: clusters ---------------------------------------------------------------


def _transaction_clusters(spark: SparkSession, d: str) -> DataFrame:
    return gridcluster.clusters(table(spark, d, "creditcard").withColumnRenamed("row_id", "id"), V_COLUMNS, radius=0.4, least=12)


def _trial_clusters(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "hdbscan_grid_results_by_fold")
    latest = history.groupBy("trial_id").agg(F.max_by(F.struct("run_id", "n_clusters", "n_noise_points"), F.struct("logged_at", "run_id", "n_clusters", "n_noise_points")).alias("r"))
    return gridcluster.box_clusters(latest.select(F.col("trial_id").alias("id"), "r.*"), "run_id", {"n_clusters": 2, "n_noise_points": 200}, least=4)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of the clusters of transactions and of grid trials."""
    kinds = {"transaction": _transaction_clusters(spark, d), "trial": _trial_clusters(spark, d)}
    a, b = (m.select(F.lit(kind).alias("record_kind"), "cluster_id", "member_id") for kind, m in kinds.items())
    return a.unionByName(b)


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of every cluster."""
    kinds = {"transaction": _transaction_clusters(spark, d), "trial": _trial_clusters(spark, d)}
    a, b = (gridcluster.describe(materialize(m, "members")).withColumn("record_kind", F.lit(kind)) for kind, m in kinds.items())
    return a.unionByName(b).select("record_kind", "cluster_id", "size", "typical_members", "densest_cell")


def _components(kind: str, links: str) -> str:
    """Members of the components of links (a, b), which have both directions and every id with itself."""
    return f"""{kind}_reach(a, b) AS (SELECT a, b FROM {links} UNION SELECT r.a, l.b FROM {kind}_reach r JOIN {links} l ON r.b = l.a),
{kind}_label AS (SELECT a AS id, min(b) AS label, count(*) AS size FROM {kind}_reach GROUP BY a)"""


P3_FOUND = f"""
WITH RECURSIVE t AS (SELECT row_id AS id, {", ".join(V_COLUMNS)}, [{", ".join(V_COLUMNS)}] AS v FROM creditcard WHERE {" + ".join(V_COLUMNS)} IS NOT NULL),
t_links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON b.V1 BETWEEN a.V1 - 0.41 AND a.V1 + 0.41 AND {" AND ".join(f"abs(a.{c} - b.{c}) <= 0.41" for c in V_COLUMNS[1:])} WHERE list_distance(a.v, b.v) <= 0.4 + 1e-9),
h AS (SELECT * FROM hdbscan_grid_results_by_fold QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY logged_at DESC NULLS LAST, run_id DESC NULLS LAST, n_clusters DESC NULLS LAST, n_noise_points DESC NULLS LAST) = 1),
h_links AS MATERIALIZED (SELECT a.trial_id AS a, b.trial_id AS b FROM h a JOIN h b ON a.run_id = b.run_id AND abs(a.n_clusters - b.n_clusters) <= 2 AND abs(a.n_noise_points - b.n_noise_points) <= 200),
{_components("t", "t_links")},
{_components("h", "h_links")}
SELECT 'transaction' AS record_kind, label AS cluster_id, id AS member_id FROM t_label WHERE size >= 12
UNION ALL SELECT 'trial', label, id FROM h_label WHERE size >= 4
"""


# --- 4: samples with wanted category shares ----------------------------------


def _draw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    identity = ["Time", *V_COLUMNS, "Amount"]
    rows = table(spark, d, "creditcard").select("batch_id", F.col("Class").alias("category"), "row_id", *identity)
    return cube.draw(rows, table(spark, d, "sample_target").withColumnRenamed("Class", "category"), identity)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Requests' classes of which less was drawn than needed."""
    return _draw(spark, d)[1].where("drawn < need").select("request_id", F.col("category").alias("Class"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The transactions drawn for every request."""
    return _draw(spark, d)[0].select("request_id", F.col("category").alias("Class"), "row_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Need, supply and drawn of every request and Class, with wanted and reached share."""
    r = _draw(spark, d)[1]
    return r.select("request_id", F.col("category").alias("Class"), "need", "supply", "drawn", F.round("target_share", 6).alias("target_share"), F.round("share", 6).alias("share"))


_P4_NEEDS = f"""
WITH pool AS (SELECT DISTINCT batch_id, Class, Time, {", ".join(V_COLUMNS)}, Amount FROM creditcard WHERE Class IS NOT NULL),
supply AS (SELECT batch_id, Class, count(*) AS supply FROM pool GROUP BY ALL),
needs AS (SELECT t.request_id, t.Class, t.target_share, greatest(t.min_rows, CAST(round(t.target_share * t.sample_size) AS BIGINT)) AS need, coalesce(s.supply, 0) AS supply
FROM sample_target t LEFT JOIN supply s ON t.batch_id = s.batch_id AND t.Class = s.Class)
"""
P4_FOUND = _P4_NEEDS + "SELECT request_id, Class FROM needs WHERE supply < need"
P4_REPORT = _P4_NEEDS + """
SELECT request_id, Class, CAST(need AS BIGINT) AS need, supply, CAST(least(need, supply) AS BIGINT) AS drawn, round(target_share, 6) AS target_share,
round(least(need, supply) / nullif(sum(least(need, supply)) OVER (PARTITION BY request_id), 0), 6) AS share FROM needs
"""


# --- 5: records across splits ---------------------------------------------------


def _splits(spark: SparkSession, d: str) -> DataFrame:
    part = F.lower(F.trim("part"))
    return table(spark, d, "fold_partition").select(F.col("fold").cast("bigint").alias("split"), part.alias("part"), "row_id").where("split is not null and row_id is not null and part in ('train', 'val', 'test')").distinct()


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    splits = _splits(spark, d).withColumn("train", F.col("part") == "train")
    return chunks.overlaps(table(spark, d, "creditcard"), splits, V_COLUMNS, {"Time": (600.0, 60.0), "Amount": (1.0, 0.05)})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and an evaluated transaction that are (almost) the same."""
    return _overlaps(spark, d).select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b")).distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Evaluated transactions, those that stand in the training part too, and pairs, per fold, part and source."""
    hit = _overlaps(spark, d).groupBy("split", F.col("eval_id").alias("row_id")).agg(F.count("*").alias("pairs"))
    rows = _splits(spark, d).where("part <> 'train'").join(table(spark, d, "creditcard").select("row_id", "source"), "row_id").join(hit, ["split", "row_id"], "left")
    return rows.groupBy(F.col("split").cast("int").alias("fold"), "part", "source").agg(F.count("*").alias("transactions"), F.count("pairs").alias("also_in_train"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def p5_fractions(spark: SparkSession, d: str) -> DataFrame:
    """The largest share of its fields that an evaluated transaction has in chunks of a training one, from 1/2 on."""
    splits = _splits(spark, d).withColumn("train", F.col("part") == "train")
    pairs = chunks.candidates(table(spark, d, "creditcard"), splits, V_COLUMNS, {"Time": (600.0, 60.0), "Amount": (1.0, 0.05)})
    return pairs.groupBy(F.col("split").cast("int").alias("fold"), F.col("eval_id").alias("row_id")).agg(F.round(F.max("overlap"), 6).alias("overlap"), F.count("*").alias("training_rows"))


_DIFFERING = " + ".join(f"CASE WHEN (a.{c} IS NULL AND b.{c} IS NULL) OR abs(a.{c} - b.{c}) <= 0.01 + 1e-9 THEN 0 ELSE 1 END" for c in V_COLUMNS)
_P5_PAIRS = f"""
WITH part AS (SELECT DISTINCT fold, lower(trim(part)) AS part, row_id FROM fold_partition WHERE lower(trim(part)) IN ('train', 'val', 'test')),
x AS (SELECT p.fold, p.part, CAST(floor(c.Time / 60) AS BIGINT) AS minute, c.* FROM part p JOIN creditcard c ON p.row_id = c.row_id WHERE Time IS NOT NULL AND Amount IS NOT NULL),
pairs AS (SELECT a.fold, a.row_id AS train_id, b.row_id AS eval_id FROM (SELECT *, minute + unnest([-1, 0, 1]) AS m FROM x WHERE part = 'train') a JOIN (SELECT *, minute AS m FROM x WHERE part <> 'train') b ON a.fold = b.fold AND a.m = b.m
WHERE abs(a.Time - b.Time) <= 60 AND abs(a.Amount - b.Amount) <= 0.05 + 1e-9 AND {_DIFFERING} <= 2)
"""
P5_FOUND = _P5_PAIRS + "SELECT DISTINCT least(train_id, eval_id) AS row_id_a, greatest(train_id, eval_id) AS row_id_b FROM pairs"
P5_COUNTS = _P5_PAIRS + """, hit AS (SELECT fold, eval_id AS row_id, count(*) AS pairs FROM pairs GROUP BY ALL)
SELECT p.fold, p.part, c.source, count(*) AS transactions, count(h.pairs) AS also_in_train, CAST(coalesce(sum(h.pairs), 0) AS BIGINT) AS pairs
FROM part p JOIN creditcard c ON p.row_id = c.row_id LEFT JOIN hit h ON p.row_id = h.row_id AND p.fold = h.fold WHERE p.part <> 'train' GROUP BY ALL
"""


# --- 6: containers ------------------------------------------------------------

CAPACITY = 1024


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents").select(F.col("doc_id").alias("id"), token_count(F.col("text")).alias("tokens")), CAPACITY).withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut."""
    return _packed(spark, d).groupBy("doc_id").count().where("count > 1").select("doc_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every piece of every document."""
    return _packed(spark, d).select("container_id", "doc_id", "piece", "token_from", "tokens")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by the tokens they hold."""
    held = _packed(spark, d).where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("tokens_held"))
    return held.groupBy("tokens_held").agg(F.count("*").alias("containers"))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens placed, containers over the capacity, documents cut without need, and tokens placed twice or not at all."""
    rows = materialize(_packed(spark, d), "packed")
    over = rows.where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("overfull"))
    own = rows.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("placed"), F.max(F.col("token_from") + F.col("tokens")).alias("end"))
    total = own.agg(F.count("*").alias("documents"), F.sum("placed").alias("tokens"), F.count_if((F.col("pieces") > 1) & (F.col("placed") <= CAPACITY)).alias("cut_needlessly"), F.count_if(F.col("placed") != F.col("end")).alias("misplaced"))
    (overfull,) = over.first()
    return total.withColumn("overfull", F.lit(overfull))


P6_CHECKED = f"SELECT count(*) AS documents, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS cut_needlessly, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS overfull FROM documents"
P6_FOUND = f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '{TOKEN}')) > {CAPACITY}"


# --- 7: mixtures ---------------------------------------------------------------


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens"))
    return mixing.mix(docs, table(spark, d, "mix_target"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short of their share of a plan."""
    return _mixed(spark, d)[1].where("short").select("plan_id", "source")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every copy of every document in every plan's mixture."""
    return _mixed(spark, d)[0].select("plan_id", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of every plan's sources."""
    return _mixed(spark, d)[1].withColumns({c: F.round(c, 6) for c in ("target_share", "rate", "actual_share")})


_P7_RATES = f"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS tokens FROM documents WHERE source IS NOT NULL),
totals AS (SELECT source, sum(tokens) AS available FROM docs GROUP BY source),
p AS (SELECT m.plan_id, m.source, m.target_share, m.max_repeats, CAST(coalesce(t.available, 0) AS BIGINT) AS available_tokens FROM mix_target m LEFT JOIN totals t ON m.source = t.source),
once AS (SELECT plan_id, sum(available_tokens) AS t FROM (SELECT DISTINCT plan_id, source, available_tokens FROM p) GROUP BY plan_id),
rates AS (SELECT p.*, least(CASE WHEN available_tokens = 0 THEN 0.0 ELSE target_share * t / available_tokens END, CAST(max_repeats AS DOUBLE)) AS rate,
max_repeats * available_tokens < target_share * t AS short FROM p JOIN once ON p.plan_id = once.plan_id),
mixed AS (SELECT r.plan_id, r.source, d.doc_id, d.tokens, CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('42:' || r.plan_id || ':' || d.doc_id), 1, 12) AS BIGINT) / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM docs d JOIN rates r ON d.source = r.source)
"""
P7_FOUND = _P7_RATES + "SELECT plan_id, source FROM rates WHERE short"
P7_MIXTURE = _P7_RATES + "SELECT plan_id, source, doc_id, unnest(range(1, copies + 1))::INTEGER AS copy FROM mixed WHERE copies > 0"
P7_REPORT = _P7_RATES + """, got AS (SELECT plan_id, source, sum(tokens * copies) AS n FROM mixed GROUP BY ALL),
r AS (SELECT rates.*, CAST(coalesce(n, 0) AS BIGINT) AS mixed_tokens FROM rates LEFT JOIN got ON rates.plan_id = got.plan_id AND rates.source = got.source)
SELECT plan_id, source, round(target_share, 6) AS target_share, available_tokens, round(rate, 6) AS rate, mixed_tokens,
round(mixed_tokens / nullif(sum(mixed_tokens) OVER (PARTITION BY plan_id), 0), 6) AS actual_share, short FROM r
"""


# --- 8: spam pages -------------------------------------------------------------


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("host"), "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of keywords, links or tags."""
    return stuffing.spam_pages(_pages(spark, d)).select(F.col("id").alias("doc_id"))


def p8_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Words in lists, in pieces stitched from other hosts' phrases, and in such phrases at all, of every page."""
    return stuffing.evidence(_pages(spark, d)).select(F.col("id").alias("doc_id"), "words", "listed", "stitched", "replicated", F.round("share", 6).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k.lower(): v for k, v in globals().items() if k[0] == "P" and k[1].isdigit()}
