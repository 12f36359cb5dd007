"""Aggregation patterns used by several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions.columns import cols, month_of, pct


def rate_by(
    df: DataFrame,
    keys: Sequence[str],
    flag: str,
    n: str = "n",
    flagged: str = "churned",
    rate: str = "churn_pct",
    digits: int = 1,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Rows, flagged rows and the flagged percentage per combination of ``keys``."""
    counts = df.groupBy(*keys).agg(
        *cols(f"count(*) AS {n}", f"count_if({flag}) AS {flagged}", *extra)
    )
    return counts.withColumn(rate, F.expr(pct(flagged, n, digits)))


def monthly(df: DataFrame, column: str, *aggs: str) -> DataFrame:
    return df.groupBy(F.expr(f"{month_of(column)} AS month")).agg(*cols(*aggs))


def exact_median(df: DataFrame, value: str, group: str) -> DataFrame:
    """Median of an integer column per group, interpolated, as (group, median).

    Works on the value histogram. The first pass finds which 65,536-wide slice of the integer range
    holds the middle ranks, the second reads only that slice, so no task ever sorts more than
    65,536 rows of a group whatever the number of rows or of distinct values.
    """
    # Both uses of the histogram get the NULL filters of the join below, so they stay one shuffle.
    hist = (
        df.groupBy(group, F.col(value).cast("bigint").alias("v"))
        .agg(F.count("*").alias("c"))
        .withColumn("slice", F.shiftright("v", 16))
        .filter(F.col(group).isNotNull() & F.col("v").isNotNull() & F.col("slice").isNotNull())
    )
    slices = hist.groupBy(group, "slice").agg(F.sum("c").alias("c"))
    running = W.partitionBy(group).orderBy("slice")
    total = F.sum("c").over(W.partitionBy(group))
    upto = F.sum("c").over(running)
    middle = slices.select(
        group,
        "slice",
        (upto - F.col("c")).alias("before"),
        upto.alias("upto"),
        F.floor((total + 1) / 2).alias("lo"),
        F.floor((total + 2) / 2).alias("hi"),
    ).filter("(lo > before AND lo <= upto) OR (hi > before AND hi <= upto)")
    inner = W.partitionBy(group, "slice").orderBy("v")
    rank = F.col("before") + F.sum("c").over(inner)
    # "middle" has at most two rows per group
    return (
        hist.join(middle.select(group, "slice", "before", "lo", "hi"), [group, "slice"])
        .select(group, "v", "lo", "hi", (rank - F.col("c")).alias("after"), rank.alias("rank"))
        .filter("(lo > after AND lo <= rank) OR (hi > after AND hi <= rank)")
        .groupBy(group)
        .agg(F.avg("v").alias("median"))
    )
