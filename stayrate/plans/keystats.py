"""Statistics of join keys kept beside a table, so that no query looks for heavy keys itself.

``analyze_keys`` sketches the key columns of each data file once, and merges the sketches of the files
a table has now into a list of its most frequent values. Queries read that list, a small JSON file, on
the driver while they are planned, without a Spark job. After new files have arrived, another call
sketches only those. A folder holds

    <table>/sketches/<run>/    a row per file: file, n, a frequent-items sketch per key
    <table>/frequent.json      {"rows": n, "keys": {key: [[value, rows], ...]}}

The list only steers how joins spread rows, so one that is out of date costs time, never rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.plans.files import children, read_text, replace_text
from stayrate.plans.joins import HotKeys

MOST = 1000  # values listed per key: every one with more than 0.1 % of the rows
TRACKED = 10 * MOST  # items a sketch follows; its error is a small part of 0.1 %


def _files(df: DataFrame) -> list[str]:
    """Data files of a frame as its ``_metadata`` names them."""
    return [file.replace("file:///", "file:/", 1) for file in df.inputFiles()]


def _folders(spark: SparkSession, path: str) -> list[str]:
    return [place for _, place, _, folder in children(spark, path) if folder]


def _states(keys: Sequence[str]) -> list:
    made = [f"approx_top_k_accumulate(`{key}`, {TRACKED}) AS `{key}`" for key in keys]
    return [F.expr("count(*) AS n"), *map(F.expr, made)]


def sketch_new_files(df: DataFrame, keys: Sequence[str], folder: str) -> int:
    """Sketch the files of ``df`` that no earlier call has; the number of them.

    One pass over the key columns of these files; only sketches are shuffled. A frame that is not read
    from files counts as one file and is sketched anew.
    """
    spark = df.sparkSession
    files = _files(df)
    if not files:
        rows = df.agg(*_states(keys)).withColumn("file", F.lit("*"))
        rows.write.mode("overwrite").parquet(f"{folder}/sketches/whole")
        return 1
    known = {row["file"] for row in _sketches(spark, folder).select("file").collect()} if _folders(
        spark, f"{folder}/sketches"
    ) else set()
    new = [file for file in files if file not in known]
    if not new:
        return 0
    file = F.col("_metadata.file_path")
    some = df if len(new) == len(files) else df.filter(file.isin(new))
    # Files without rows give no sketch; they are looked at again, which costs nothing.
    some.groupBy(file.alias("file")).agg(*_states(keys)).write.parquet(
        f"{folder}/sketches/{uuid4().hex}"
    )
    return len(new)


def _sketches(spark: SparkSession, folder: str) -> DataFrame:
    runs = [spark.read.parquet(path) for path in _folders(spark, f"{folder}/sketches")]
    return reduce(DataFrame.unionByName, runs)


def merge_sketches(df: DataFrame, keys: Sequence[str], folder: str) -> dict:
    """Merge the sketches of the files that ``df`` has now and write the list of frequent values."""
    spark = df.sparkSession
    rows = _sketches(spark, folder)
    files = _files(df)
    if files:
        now = spark.createDataFrame([(file,) for file in files], "file string")
        rows = rows.join(now, "file", "left_semi").dropDuplicates(["file"])
    merged = rows.agg(
        F.expr("coalesce(sum(n), 0) AS n"),
        *[
            F.expr(
                f"to_json(transform(approx_top_k_estimate(approx_top_k_combine(`{key}`, {TRACKED}),"
                f" {MOST}), x -> struct(x.item AS v, x.count AS n))) AS `{key}`"
            )
            for key in keys
        ],
    ).first()
    # Struct fields that are null are left out of the JSON text; null keys join nothing.
    frequent = {
        key: [[item["v"], item["n"]] for item in json.loads(merged[key] or "[]") if "v" in item]
        for key in keys
    }
    found = {"rows": merged["n"], "keys": frequent}
    replace_text(spark, f"{folder}/frequent.json", json.dumps(found))
    return found


def analyze_table(df: DataFrame, keys: Sequence[str], folder: str) -> int:
    """Bring the statistics of one table up to date; the number of files sketched."""
    sketched = sketch_new_files(df, keys, folder)
    merge_sketches(df, keys, folder)
    return sketched


def known_hot_keys(
    spark: SparkSession, folder: str, share: float, min_rows: int
) -> dict[str, HotKeys]:
    """Values of each key above ``share`` of the rows, and ``min_rows``, with the pieces they need."""
    content = read_text(spark, f"{folder}/frequent.json")
    if content is None:
        return {}
    found = json.loads(content)
    limit = max(found["rows"] * share, min_rows)
    return {
        key: [(value, -int(-n // limit)) for value, n in values if n > limit]
        for key, values in found["keys"].items()
    }
