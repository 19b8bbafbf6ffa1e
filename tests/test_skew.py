"""Joins with heavy keys."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contingo.operators.skew import HotKeys


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(3000).select((F.when(F.col("id") % 10 < 3, 7).when(F.col("id") % 10 == 3, F.lit(None))
                                     .otherwise(F.col("id") % 500)).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 400)] + [(7, "again"), (None, "none")], "k long, v string")
    return left, right


@pytest.mark.parametrize("how", ["left", "inner"])
def test_rows_of_the_plain_join(sides, how):
    left, right = sides
    hot = HotKeys(left, ["k"], share=0.2, ways=6)
    got = Counter(map(tuple, hot.join(left, right, ["k"], how).select("k", "x", "v").collect()))
    assert got == Counter(map(tuple, left.join(right, ["k"], how).select("k", "x", "v").collect()))


def test_the_heavy_key_is_found_and_spread(spark, sides):
    left, right = sides
    hot = HotKeys(left, ["k"], share=0.2, ways=6)
    assert spark.range(1).select(hot.heavy()).first()[0] == [7]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = lambda df: {r[0] for r in df.where("k = 7").select(F.spark_partition_id()).distinct().collect()}
        assert len(tasks(left.join(right, ["k"]).select("k", "x"))) == 1
        assert len(tasks(hot.join(left, right, ["k"], "inner"))) > 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_no_heavy_key_and_empty_sides(spark, sides):
    left, right = sides
    hot = HotKeys(left.limit(0), ["k"])
    assert hot.join(left.limit(0), right, ["k"]).count() == 0
    assert hot.join(left, right.limit(0), ["k"]).count() == 3000
    with pytest.raises(ValueError):
        hot.join(left, right, ["k"], "full")
