"""Write the extracts, report their sizes, and read them back.

An extract is a folder with a ``manifest.json`` and a folder for each attempt to write it. The manifest
names the attempt that counts, with its rows, columns and files, and is replaced in one step after the
attempt is whole. So a run that dies leaves the extract of the run before, and readers that began on it
keep its files until the next but one write.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.operators.dashboard import dashboard_from
from stayrate.operators.facts import facts_of
from stayrate.operators.marts import MART_SCHEMAS, MARTS
from stayrate.params import Params
from stayrate.plans.files import children, delete_folder, new_folder, read_text, replace_text
from stayrate.roles import Roles
from stayrate.sources.tables import read_csv_table

MANIFEST = "manifest.json"


class BrokenExtract(ValueError):
    """An extract that is not what its manifest says."""


def manifest_of(spark: SparkSession, path: str) -> dict:
    content = read_text(spark, f"{path}/{MANIFEST}")
    if content is None:
        raise BrokenExtract(f"{path} has no manifest: no write of it has ended")
    return json.loads(content)


def _data_files(spark: SparkSession, path: str) -> dict[str, int]:
    return {
        name: size
        for name, _, size, folder in children(spark, path)
        if not folder and not name.startswith(("_", "."))
    }


def write_extract(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Write one extract and return its row count, counted while writing."""
    spark = df.sparkSession
    attempt = f"attempt-{uuid4().hex}"
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    if fmt == "csv":
        writer.option("header", True).csv(f"{path}/{attempt}")
    else:
        writer.format(fmt).save(f"{path}/{attempt}")
    rows = seen.get["rows"]
    old = read_text(spark, f"{path}/{MANIFEST}")
    manifest = {
        "attempt": attempt,
        "format": fmt,
        "rows": rows,
        "columns": [list(column) for column in df.dtypes],
        "files": _data_files(spark, f"{path}/{attempt}"),
    }
    replace_text(spark, f"{path}/{MANIFEST}", json.dumps(manifest))
    keep = {attempt, json.loads(old)["attempt"] if old else attempt}
    for name, place, _, folder in children(spark, path):
        if folder and name.startswith("attempt-") and name not in keep:
            delete_folder(spark, place)
    return rows


def write_extracts(
    roles: Roles,
    params: Params,
    folder: str,
    fmt: str = "parquet",
    names: Iterable[str] = tuple(MARTS),
) -> dict[str, int]:
    """Write extracts to ``<folder>/<name>``, from one reduction of usage; the rows of each."""
    facts = facts_of(roles, params)
    return {
        name: write_extract(MARTS[name](roles, params, facts=facts), f"{folder}/{name}", fmt)
        for name in names
    }


def read_extract(
    spark: SparkSession, folder: str, name: str, fmt: str | None = None
) -> DataFrame:
    """An extract with the types its reports declare, checked against its manifest.

    Columns, files, their sizes and the number of rows must be those the manifest names; an extract
    that lacks some, or was changed after it was written, raises :class:`BrokenExtract`.
    """
    path = f"{folder}/{name}"
    manifest = manifest_of(spark, path)
    schema = T.StructType.fromDDL(MART_SCHEMAS[name])
    columns = [[field.name, field.dataType.simpleString()] for field in schema.fields]
    if manifest["columns"] != columns:
        raise BrokenExtract(f"{path} has columns {manifest['columns']}, not {columns}")
    if fmt not in (None, manifest["format"]):
        raise BrokenExtract(f"{path} is {manifest['format']}, not {fmt}")
    place = f"{path}/{manifest['attempt']}"
    files = _data_files(spark, place)
    if files != manifest["files"]:
        changed = sorted(dict(files.items() ^ manifest["files"].items()))
        raise BrokenExtract(f"{path}: files are not as they were written: {changed[:10]}")
    if manifest["format"] == "csv":
        df = read_csv_table(spark, place, schema)
    else:
        df = spark.read.schema(schema).format(manifest["format"]).load(place)
    rows = df.count()
    if rows != manifest["rows"]:
        raise BrokenExtract(f"{path} has {rows} rows, not {manifest['rows']}")
    return df


def dashboard_from_extracts(
    spark: SparkSession, folder: str, fmt: str | None = None
) -> DataFrame:
    return dashboard_from(lambda name: read_extract(spark, folder, name, fmt))


def dashboard_through_extracts(roles: Roles, params: Params) -> DataFrame:
    """All worksheets, from eight extracts that are written and read back."""
    spark = roles.accounts.sparkSession
    folder = new_folder(spark, "extracts")
    write_extracts(roles, params, folder)
    return dashboard_from_extracts(spark, folder)
