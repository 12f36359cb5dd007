"""Lookups on skewed keys, and the helpers around them."""

from __future__ import annotations

import random

import pytest
from row_values import rows_of
from pyspark.sql import functions as F

from stayrate.operators import kpis, marts, quality, retention
from stayrate.plans.aggregates import exact_median
from stayrate.plans.joins import hot_keys, lookup, side_by_side
from stayrate.sources.retail import PARAMS, retail_roles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows of which a third belong to key 7."""
    return (
        spark.range(0, 20_000, 1, 8)
        .withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(100 + F.col("id") % 4000))
        .withColumn("k", F.col("k").cast("bigint"))
    )


def test_hot_keys_finds_the_heavy_key_only(skewed):
    found = dict(hot_keys(skewed, ["k"], share=0.01, min_rows=100)["k"])
    assert set(found) == {7}
    assert found[7] == 34  # a third of the rows in pieces of one percent


def test_hot_keys_of_even_data_is_empty(spark):
    assert hot_keys(spark.range(10_000), ["id"], share=0.001, min_rows=1) == {"id": []}
    assert hot_keys(spark.range(0), ["id"], share=0.001, min_rows=1) == {"id": []}


def test_hot_keys_respects_the_row_floor(skewed):
    assert hot_keys(skewed, ["k"], share=0.01, min_rows=1_000_000) == {"k": []}


def test_lookup_with_hot_keys_equals_plain_join(spark, skewed):
    dim = spark.range(0, 6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = [(7, 34), (101, 3), (999_999, 5)]  # one of them is not in either side
    plain = lookup(skewed, dim, "k")
    split = lookup(skewed, dim, "k", hot)
    assert split.columns == plain.columns
    assert sorted(rows_of(split)) == sorted(rows_of(plain))


def test_lookup_drops_rows_without_dimension_and_null_keys(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, x string")
    dim = spark.createDataFrame([(1, "d")], "k long, v string")
    for hot in ([], [(1, 4), (2, 2)]):
        assert rows_of(lookup(fact, dim, "k", hot)) == [(1, "a", "d")]


def test_hot_rows_are_spread_over_pieces(spark, skewed):
    dim = spark.range(0, 6000).withColumnRenamed("id", "k")
    plan = lookup(skewed, dim, "k", [(7, 34)])._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" in plan


def test_hot_rows_of_one_partition_fill_every_piece(spark):
    fact = spark.range(20_000).select(F.lit(7).cast("long").alias("k"), "id").coalesce(1)
    dim = spark.createDataFrame([(7, "d")], "k long, v string")
    pieces = 11
    joined = lookup(fact, dim, "k", [(7, pieces)])
    assert joined.count() == 20_000
    piece = F.pmod(F.xxhash64("k", "id"), F.lit(pieces))
    counts = [row["count"] for row in fact.groupBy(piece.alias("p")).count().collect()]
    assert len(counts) == pieces and min(counts) > 20_000 / pieces / 2


def test_left_lookup_keeps_rows_without_dimension(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, x string")
    dim = spark.createDataFrame([(1, "d")], "k long, v string")
    for hot in ([], [(1, 4), (2, 2)]):
        got = lookup(fact, dim, "k", hot, "left").select("x", "v")
        assert sorted(rows_of(got)) == [("a", "d"), ("b", None), ("c", None)]


def test_results_do_not_depend_on_hot_keys(spark):
    plain = retail_roles(spark, FOLDER)
    split = retail_roles(spark, FOLDER, hot_share=0.0005, hot_min_rows=2)
    assert split.hot("feature_usage", "subscription_id")
    assert split.hot("subscriptions", "account_id")
    for operator in (
        retention.retention_cohort_matrix,
        kpis.kpi_support_load,
        marts.mart_account_metrics,
        quality.dq_usage_after_churn,
    ):
        assert sorted(rows_of(operator(split, PARAMS)), key=repr) == sorted(
            rows_of(operator(plain, PARAMS)), key=repr
        )


def test_hot_keys_are_looked_for_once(spark):
    roles = retail_roles(spark, FOLDER)
    first = roles.hot("feature_usage", "subscription_id")
    assert roles.hot("feature_usage", "subscription_id") is first


def test_side_by_side_keeps_nulls(spark):
    a = spark.createDataFrame([(1, None)], "a long, b string")
    b = spark.createDataFrame([(True,)], "c boolean")
    assert rows_of(side_by_side(a, b)) == [(1, None, True)]


@pytest.mark.parametrize("values", [[1, 2, 3, 10], [5], [3, 3, 9], [-70_000, 70_000, 200_000, 1]])
def test_exact_median_small(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v int")
    expected = df.agg(F.median("v")).first()[0]
    assert rows_of(exact_median(df, "v", "g")) == [("g", expected)]


def test_exact_median_many_slices(spark):
    draw = random.Random(1)
    rows = [(i % 3 == 0, draw.randint(-(2**31), 2**31 - 1)) for i in range(5001)]
    df = spark.createDataFrame([*rows, (True, None)], "g boolean, v int")
    expected = rows_of(df.groupBy("g").agg(F.median("v")))
    assert sorted(rows_of(exact_median(df, "v", "g"))) == sorted(expected)


def test_date_bounds_reach_the_scan_with_and_without_hot_keys(spark):
    for options in ({}, {"hot_share": 0.0005, "hot_min_rows": 2}):
        roles = retail_roles(spark, FOLDER, **options)
        df = retention.retention_by_source(roles, PARAMS)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "LessThan(l_shipdate,1996-12-01T00:00)" in plan
