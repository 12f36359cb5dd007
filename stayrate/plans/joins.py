"""Dimension lookups that survive a key holding a large share of the rows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HotKeys = list[tuple[object, int]]  # (key value, number of pieces its rows are split into)


def hot_keys(df: DataFrame, keys: Sequence[str], share: float, min_rows: int) -> dict[str, HotKeys]:
    """Values of each key that hold more than ``share`` of the rows, with the pieces each needs.

    One pass over the key columns with frequent-items sketches per task, so no key is shuffled. At
    most ``1 / share`` values a key come back. The sketch may miss a value close to the threshold;
    adaptive skew handling covers those.
    """
    most = int(1 / share)
    limit = F.greatest(F.col("n") * share, F.lit(float(min_rows)))
    counts = [F.expr(f"struct(count(`{key}`) AS n, {_top(key, most)} AS top)") for key in keys]
    row = df.agg(*(c.alias(key) for c, key in zip(counts, keys)))
    found: dict[str, HotKeys] = {}
    named = [
        row.select(F.lit(key).alias("key"), F.col(f"`{key}`.n"), F.explode(f"`{key}`.top").alias("t"))
        .filter(F.col("t.count") > limit)
        .select(
            "key",
            F.to_json(F.struct("t.item")).alias("item"),
            F.ceil(F.col("t.count") / limit).cast("int").alias("pieces"),
        )
        for key in keys
    ]
    for hot in reduce(DataFrame.union, named).collect():
        found.setdefault(hot["key"], []).append((json.loads(hot["item"])["item"], hot["pieces"]))
    return {key: found.get(key, []) for key in keys}


def _top(key: str, most: int) -> str:
    return f"approx_top_k(`{key}`, {most}, {10 * most})"


def lookup(
    fact: DataFrame, dim: DataFrame, key: str, hot: HotKeys = (), how: str = "inner"
) -> DataFrame:
    """Join of ``fact`` with ``dim``, which has one row per ``key``; inner or left.

    Without hot keys this is a plain join and Spark picks broadcast or shuffle by size. Rows of a
    hot key are split by a hash of the whole row, so the pieces do not depend on how files are laid
    out and stay the same if a task is run again, and its ``dim`` row is repeated once per piece: at
    most ``1 / share`` extra rows.
    """
    if not hot:
        return fact.join(dim, key, how)
    schema = f"`{key}` {dim.schema[key].dataType.simpleString()}, _pieces int"
    pieces = F.broadcast(dim.sparkSession.createDataFrame(list(hot), schema))
    many = F.coalesce(F.col("_pieces"), F.lit(1))
    left = fact.join(pieces, key, "left").withColumn(
        "_piece", F.pmod(F.xxhash64(*fact.columns), many.cast("bigint"))
    )
    right = dim.join(pieces, key, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), many.cast("bigint") - 1))
    )
    return left.drop("_pieces").join(right.drop("_pieces"), [key, "_piece"], how).drop("_piece")


@contextmanager
def small_sides_hashed(spark: SparkSession, limit: str = "64m") -> Iterator[None]:
    """Inside, AQE may hash a side whose partitions are all below ``limit``, instead of sorting both.

    A limit that the session has set itself stays.
    """
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(key, None)
    unset = before in (None, "0", "0b")
    if unset:
        spark.conf.set(key, limit)
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Put the columns of one-row frames into one row, by union and aggregate."""
    first, *rest = frames
    stacked = first
    for frame in rest:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for frame in frames for c in frame.columns])
