"""File sources and sinks: transactions as CSV, folds, and their metadata as JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzfold.sources import shared
from quartzfold.sources.tables import V_COLUMNS

#: Columns of the transactions in their order.
TRANSACTIONS = T.StructType([T.StructField(c, T.DoubleType()) for c in ["Time", *V_COLUMNS, "Amount"]] + [T.StructField("Class", T.IntegerType())])
METADATA = "fold int, random_state bigint, target_column string, num_train_samples bigint, num_test_samples bigint, class_distribution_train map<string,double>, class_distribution_test map<string,double>, train_indices array<bigint>, test_indices array<bigint>, undersampling struct<method:string,legitimate_fraction:double,seed:array<bigint>,num_legitimate_before:bigint,num_legitimate_after:bigint,num_frauds:bigint,ks_max_statistic:double,ks_by_column:map<string,struct<statistic:double,p_value:double>>>"


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transactions from CSV with a header, under an explicit schema; a malformed row fails the read."""
    return spark.read.schema(TRANSACTIONS).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_parts(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Rows with ``fold`` and ``part``, a folder for each, so that a later read prunes to what it needs."""
    w = df.write.mode("overwrite").partitionBy("fold", "part")
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


def read_part(spark: SparkSession, path: str, fold: int, part: str) -> DataFrame:
    """The rows of one fold and part."""
    return spark.read.parquet(path).where((F.col("fold") == fold) & (F.col("part") == part)).drop("fold", "part")


def fold_ids(names: Sequence[str], expected: int | None = None) -> list[int]:
    """Fold numbers of files named fold_<k>_train.*; none, or another number than expected, raises."""
    found = sorted({int(m[1]) for n in names if (m := re.search(r"(?:^|/)fold_(\d+)_train\.", n))})
    if not found or (expected is not None and len(found) != expected):
        raise ValueError(f"found {len(found)} folds")
    return found


def fold_metadata(folds: DataFrame, seed: int, target: str = "Class") -> DataFrame:
    """Per fold the sizes and class shares of its training and test part."""
    n = folds.agg(F.max("fold")).first()[0] or 0
    o = folds.select("fold", target, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("of"))
    c = o.groupBy("of", (F.col("fold") == F.col("of")).alias("test"), F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    total = c.groupBy("of", "test").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("m"))
    share = F.transform_values("m", lambda k, v: v / F.col("all"))
    side = total.withColumn("share", share)
    pick = lambda test, c: F.first(F.when(F.col("test") == test, F.col(c)), ignorenulls=True)
    return side.groupBy(F.col("of").alias("fold")).agg(F.lit(seed).alias("random_state"), F.lit(target).alias("target_column"), pick(False, "all").alias("num_train_samples"), pick(True, "all").alias("num_test_samples"), pick(False, "share").alias("class_distribution_train"), pick(True, "share").alias("class_distribution_test"))


def write_json(rows: DataFrame, folder: str, name: str = "fold_{fold}_info.json") -> None:
    """One readable JSON file per row; for the few rows of metadata only."""
    for r in rows.select(F.to_json(F.struct("*"))).toLocalIterator():
        record = json.loads(r[0])
        shared.write_text(rows.sparkSession, f"{str(folder).rstrip('/')}/{name.format(**record)}", json.dumps(record, indent=4, ensure_ascii=False))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata files under an explicit schema; the fold falls back to the file's name."""
    m = spark.read.schema(METADATA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return m.withColumn("fold", F.coalesce("fold", F.regexp_extract(F.col("_metadata.file_name"), r"fold_(\d+)", 1).try_cast("int")))


def legitimate_weight(metadata: DataFrame) -> DataFrame:
    """Rows of class 0 before undersampling per row after it, 1 where nothing was undersampled: (fold, weight)."""
    u = F.col("undersampling")
    return metadata.select("fold", F.coalesce(F.try_divide(u["num_legitimate_before"], u["num_legitimate_after"]), F.lit(1.0)).alias("weight"))
