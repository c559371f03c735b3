import re

import pytest

from quartzfold.llm.mixing import mix
from quartzfold.llm.text import token_count


def test_shares_caps_and_shortage(spark):
    docs = [(i, "big", 100) for i in range(900)] + [(1000 + i, "small", 100) for i in range(50)] + [(2000, None, 100), (2001, "big", None)]
    plans = [(1, "big", 0.5, 3), (1, "small", 0.5, 4), (2, "big", 0.9, 1), (2, "none", 0.1, 2), (3, None, 1.0, 1), (4, "small", None, None)]
    mixed, report = mix(spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint").selectExpr("*", "1 as rate", "2 as plan"), spark.createDataFrame(plans, "plan_id int, source string, target_share double, max_repeats int"))
    r = {(x["plan_id"], x["source"]): x for x in report.collect()}
    assert r[(1, "small")]["short"] and r[(1, "small")]["mixed_tokens"] == 4 * 5000
    assert not r[(1, "big")]["short"] and abs(r[(1, "big")]["mixed_tokens"] - 47500) < 5000
    assert r[(2, "none")]["short"] and r[(2, "none")]["available_tokens"] == 0
    assert abs(sum(x["actual_share"] for x in r.values() if x["plan_id"] == 1) - 1) < 1e-9
    assert all(x["copies"] <= {(1, "big"): 3, (1, "small"): 4, (2, "big"): 1}[(x["plan_id"], x["source"])] for x in mixed.collect())


def test_empty(spark):
    mixed, report = mix(spark.createDataFrame([], "doc_id bigint, source string, tokens bigint"), spark.createDataFrame([], "plan_id int, source string, target_share double, max_repeats int"))
    assert mixed.count() == report.count() == 0


@pytest.mark.parametrize("text", ["", "a b", "Ünï_1 – x²½!? (ok)…", "  x\x1cy　z", "日本語、テスト。", "a" * 100_000 + "!" * 100_000, "ée", None])
def test_tokens_are_those_of_the_public_pattern(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(token_count(__import__("pyspark").sql.functions.col("t"))).first()[0]
    assert got == len(re.findall(r"\w+|[^\w\s]+", text or ""))
