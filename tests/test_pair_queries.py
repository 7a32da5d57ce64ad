"""Pairs of customers and suppliers of a nation."""

import os

import pytest

from graphloom.plans import catalog_more  # noqa: F401  adds to the catalog
from graphloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_equal_ratios_are_found_by_equal_texts(spark, tmp_path):
    rows = lambda k: spark.createDataFrame([(1, 1, "same"), (2, 1, "other" + k), (3, 2, "same"), (4, 1, None)], f"{k}_key int, {k}_nationkey int, {k}_name string")
    rows("c").withColumnRenamed("c_key", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    rows("s").withColumnRenamed("s_key", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    df = QUERIES["sequence_ratio"](spark, str(tmp_path))
    assert sorted((r.c_custkey, r.s_suppkey) for r in df.collect()) == [(1, 1), (3, 3), (4, 4)]
    assert any("c_name" in line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_pairs_are_made_on_all_cores(spark):
    assert "RoundRobin" in QUERIES["edit_similarity"](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_pairs_are_compared_by_blocks(spark):
    assert "levenshtein" not in QUERIES["edit_similarity"](spark, SF)._jdf.queryExecution().toString()


def test_blocks_score_as_the_expression_does(spark):
    from pyspark.sql import functions as F

    from graphloom.functions.text import edit_similarity
    from graphloom.operators.edits import all_pairs

    names = ["", "a", "Customer#1", "Custmoer#12", "中文名", "ß😀x", "y" * 31 + "z", "y" * 33, "abc" * 21, "abc" * 21 + "d", "abc" * 30, "\0a\0", None]
    left = spark.createDataFrame([(i, g, n) for i, (g, n) in enumerate((g, n) for g in (1, 2, None) for n in names)], "a int, `group` int, name string")
    right = left.select(F.col("a").cast("bigint").alias("b"), "group", F.reverse("name").alias("name")).where("`group` IS NULL OR `group` < 2")
    pairs = left.alias("l").join(right.alias("r"), F.col("l.group") == F.col("r.group"))
    score = F.when(F.col("l.name").isNotNull() & F.col("r.name").isNotNull(), F.round(edit_similarity(F.col("l.name"), F.col("r.name")), 6))
    want = {(r.a, r.b): r.s for r in pairs.select("a", "b", score.alias("s")).collect()}
    got = all_pairs(left, right, "a", "b", block=4)
    assert got.count() == len(want) == len(names) ** 2
    assert {(r.a, r.b): r.score for r in got.collect()} == want and got.dtypes == [("a", "int"), ("b", "bigint"), ("score", "double")]
