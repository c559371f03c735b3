"""Mixtures of sources with wanted shares of all tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.session import materialize


def mix(documents: DataFrame, plans: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Documents with their number of copies per plan, and the report per plan and source.

    ``documents`` has doc_id, source, tokens; ``plans`` has plan_id, source,
    target_share, max_repeats. T is the tokens of all documents of a plan's
    sources, each source once. The rate of a source is target_share * T / its
    tokens, at most max_repeats; a document gets floor(rate) copies and one more
    with the probability of the fraction, decided by a hash of seed, plan and
    document, so never more than max_repeats. A source falls short if
    max_repeats * tokens < target_share * T. Documents and plan rows without a
    source never match; a null share counts as 0, null max_repeats as 1.

    Returns (plan_id, source, doc_id, tokens, copies) of the documents with a
    copy, and (plan_id, source, target_share, available_tokens, rate,
    mixed_tokens, actual_share, short), a row per plan row; actual_share is null
    in an empty mixture. Empty inputs give empty results.
    """
    docs = materialize(documents.where("source is not null").select("doc_id", "source", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")), "tokens")
    totals = docs.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    p = plans.select("plan_id", "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    p = p.join(totals, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0).cast("bigint")))
    once = p.select("plan_id", "source", "available_tokens").distinct().groupBy("plan_id").agg(F.sum("available_tokens").alias("t"))
    wanted = F.col("target_share") * F.col("t")
    rate = F.least(F.coalesce(F.try_divide(wanted, F.col("available_tokens")), F.lit(0.0)), F.col("max_repeats").cast("double"))
    rates = materialize(p.join(once, "plan_id").withColumns({"rate": rate, "short": F.col("max_repeats") * F.col("available_tokens") < wanted}), "rates")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "plan_id", "doc_id")), 1, 12), 16, 10).cast("bigint") / F.lit(float(16**12))
    whole = F.floor("rate")
    copies = (whole + F.when(u < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    mixed = docs.join(rates.where("rate > 0").select("plan_id", "source", "rate"), "source").withColumn("copies", copies).where("copies > 0")
    mixed = mixed.select("plan_id", "source", "doc_id", "tokens", "copies")
    got = mixed.groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    report = rates.join(got, ["plan_id", "source"], "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0).cast("bigint")))
    report = materialize(report, "mixed")
    total = report.groupBy("plan_id").agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = report.join(total, "plan_id").select("plan_id", "source", "target_share", "available_tokens", "rate", "mixed_tokens", F.try_divide("mixed_tokens", "all_tokens").alias("actual_share"), "short")
    return mixed, report
