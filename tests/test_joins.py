"""Joins whose hot keys are measured first."""

import pytest
from pyspark.sql import functions as F

from sieveframe.operators.joins import heavy_keys, spread_join


def sides(spark):
    """A third of the left rows hold one key, some none."""
    key = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id"))
    left = spark.range(6000).select(key.alias("k"), (F.col("id") % 50).alias("x"))
    right = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return left, right.union(spark.createDataFrame([(1, 7)], "k long, v long"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_the_plain_join(spark, how):
    left, right = sides(spark)
    assert rows(spread_join(left, right, ["k"], how, parts=8)) == rows(left.join(right, "k", how))
    assert rows(spread_join(left, right, ["k"], how, salts=4)) == rows(left.join(right, "k", how))


def test_only_measured_keys_are_cut(spark):
    left, right = sides(spark)
    found = dict(heavy_keys(left, ["k"], 8))
    hot = spark.range(1).select(F.xxhash64(F.lit(1).cast("long"))).first()[0]
    assert found == {hot: 3}
    assert heavy_keys(left.where("k > 1"), ["k"], 8) == [] and heavy_keys(left.limit(0), ["k"], 8) == []
    plan = spread_join(left.where("k > 1"), right, ["k"], parts=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "_salt" not in plan


def test_several_keys_and_clashing_values(spark):
    left = spark.createDataFrame([("a", 1, 5)] * 40 + [("a", None, 6), ("b", 2, 7), (None, None, 8)], "k string, j int, n int")
    right = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", None, "z")], "k string, j int, v string")
    assert rows(spread_join(left, right, ["k", "j"], "left", parts=4)) == rows(left.join(right, ["k", "j"], "left"))
