"""A Spark session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "stayrate", **conf: str) -> SparkSession:
    """Settings not given here keep the cluster's values; ``conf`` uses __ for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # hash instead of sort where every partition of a join is known to be small
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if session.conf.get(first, None) is None:
        # Start with more partitions than cores; AQE merges those that turn out small.
        usual = int(session.conf.get("spark.sql.shuffle.partitions"))
        session.conf.set(first, max(usual, 2 * session.sparkContext.defaultParallelism))
    return session
