"""The role tables as CSV files, and operators that read them from there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.functions.columns import cols, text
from stayrate.operators.retention import retention_by_source
from stayrate.params import Params
from stayrate.plans.files import new_folder
from stayrate.plans.lifecycle import with_feature
from stayrate.roles import TABLES, Roles
from stayrate.sources.tables import role_schema, split_csv_roles


def write_csv_roles(roles: Roles, folder: str, prefix: str = "") -> None:
    """Headered CSV files ``<folder>/<prefix><table>.csv``; usage carries the names of its features."""
    for table in TABLES:
        df = roles.table(table)
        if table == "feature_usage":
            df = with_feature(df, roles)
        names = role_schema(table).fieldNames()
        df.select(names).write.option("header", True).csv(f"{folder}/{prefix}{table}.csv")


def _through_csv(roles: Roles) -> tuple[Roles, DataFrame]:
    folder = new_folder(roles.accounts.sparkSession, "csv")
    write_csv_roles(roles, folder)
    id_type = roles.accounts.schema["account_id"].dataType
    return split_csv_roles(roles.accounts.sparkSession, folder, id_type=id_type or T.StringType())


def source_csv_row_counts(roles: Roles, params: Params) -> DataFrame:
    """Rows and rejected lines per role table, after a round trip through CSV files."""
    found, rejects = _through_csv(roles)
    counts = [
        found.table(t).agg(*cols(f"{text(t)} AS tbl", "count(*) AS rows", "0L AS rejected"))
        for t in TABLES
    ]
    refused = rejects.groupBy(F.col("table").alias("tbl")).agg(
        *cols("0L AS rows", "count(*) AS rejected")
    )
    return (
        reduce(DataFrame.unionByName, [*counts, refused])
        .groupBy("tbl")
        .agg(*cols("sum(rows) AS rows", "sum(rejected) AS rejected"))
        .orderBy("tbl")
    )


def source_csv_retention_by_source(roles: Roles, params: Params) -> DataFrame:
    """Retention by referral source, of roles read from CSV files."""
    return retention_by_source(_through_csv(roles)[0], params)
