"""The split paths for hot keys give what the plain paths give."""

import statistics

import pytest
from pyspark.sql import functions as F

from stowline.operators import skew


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def hot(spark):
    # Key 0 holds most rows.
    return spark.range(400).select(F.when(F.col("id") % 4 == 0, F.col("id") % 7).otherwise(0).alias("k"), F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, hot, how):
    small = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (9, "d")], "k long, w string")
    assert rows(skew.skew_join(hot, small, ["k"], how, hot_rows=20)) == rows(hot.join(small, "k", how))


def test_hot_keys_are_spread(hot, spark):
    small = spark.createDataFrame([(0, "a")], "k long, w string")
    plan = skew.skew_join(hot, small, ["k"], hot_rows=20)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_number_in_group(spark, hot):
    plain = skew.number_in_group(hot, ["k"], ["v"], "n")
    sliced = skew.number_in_group(hot, ["k"], ["v"], "n", group_rows=30)
    assert rows(plain) == rows(sliced)
    top = [r["n"] for r in sliced.filter("k = 0").orderBy("v").collect()]
    assert top == list(range(len(top)))


def test_exact_quantiles(spark, hot):
    points = {"mid": 0.5, "p95": 0.95, "low": 0.0}
    plain = skew.exact_quantiles(hot, ["k"], "v", points)
    split = skew.exact_quantiles(hot, ["k"], "v", points, group_rows=30)
    close = lambda df: [tuple(round(float(x), 6) for x in r) for r in rows(df)]
    assert close(plain) == close(split)
    values = [r["v"] for r in hot.filter("k = 3").collect()]
    assert {r["k"]: r["mid"] for r in plain.collect()}[3] == statistics.median(values)


def test_fits_broadcast(spark):
    df = spark.range(100)
    assert skew.fits_broadcast(df, 100) and not skew.fits_broadcast(df, 99)
    assert not skew.fits_broadcast(df, 1000, 50)
