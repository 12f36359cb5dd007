"""Read the role tables from CSV or Parquet with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.roles import TABLES, Roles

_STRING, _DATE, _BOOL = T.StringType(), T.DateType(), T.BooleanType()
_LONG, _INT, _DOUBLE, _TIME = T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()

# Ids are text in CSV deliveries; pass id_type for tables that hold numbers.
_COLUMNS: dict[str, dict[str, T.DataType | None]] = {
    "accounts": {
        "account_id": None,
        "account_name": _STRING,
        "industry": _STRING,
        "country": _STRING,
        "signup_date": _DATE,
        "referral_source": _STRING,
        "plan_tier": _STRING,
        "seats": _INT,
        "is_trial": _BOOL,
        "churn_flag": _BOOL,
    },
    "subscriptions": {
        "subscription_id": None,
        "account_id": None,
        "start_date": _DATE,
        "end_date": _DATE,
        "plan_tier": _STRING,
        "billing_frequency": _STRING,
        "mrr_amount": _DOUBLE,
        "arr_amount": _DOUBLE,
        "is_trial": _BOOL,
        "upgrade_flag": _BOOL,
        "downgrade_flag": _BOOL,
        "churn_flag": _BOOL,
        "auto_renew_flag": _BOOL,
    },
    "feature_usage": {
        "usage_id": _STRING,
        "subscription_id": None,
        "usage_date": _DATE,
        "feature_name": _STRING,
        "usage_count": _LONG,
        "usage_duration_secs": _LONG,
        "error_count": _LONG,
        "is_beta_feature": _BOOL,
    },
    "support_tickets": {
        "ticket_id": None,
        "account_id": None,
        "submitted_at": _TIME,
        "closed_at": _TIME,
        "resolution_time_hours": _DOUBLE,
        "priority": _STRING,
        "first_response_time_minutes": _DOUBLE,
        "satisfaction_score": _DOUBLE,
        "escalation_flag": _BOOL,
    },
    "churn_events": {
        "churn_event_id": None,
        "account_id": None,
        "churn_date": _DATE,
        "reason_code": _STRING,
        "refund_amount_usd": _DOUBLE,
        "is_reactivation": _BOOL,
        "feedback_text": _STRING,
    },
}


def role_schema(table: str, id_type: T.DataType = _STRING) -> T.StructType:
    return T.StructType(
        [T.StructField(name, kind or id_type) for name, kind in _COLUMNS[table].items()]
    )


RECORD = "_broken_record"


def _as_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns of headered CSV files as text, with ``RECORD`` where a line has too few or many."""
    plain = spark.read.option("header", True)
    named = plain.csv(path).schema
    with_record = T.StructType([*named.fields, T.StructField(RECORD, _STRING)])
    return (
        plain.option("enforceSchema", False)
        .option("columnPruning", False)  # a line is broken whichever of its columns are asked for
        .option("columnNameOfCorruptRecord", RECORD)
        .schema(with_record)
        .csv(path)
    )


def _cast(name: str, kind: T.DataType) -> str:
    return f"try_cast(`{name}` AS {kind.simpleString()})"


def split_csv_table(
    spark: SparkSession, path: str, schema: T.StructType, table: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Rows of headered CSV files that fit ``schema``, and the lines that do not.

    A line is rejected whole if it has too few or too many fields, or a field that is not a value of
    its column's type; an empty field is NULL and fits. Rejects name their file, the columns that do
    not fit (none if the number of fields is wrong) and the line: as it stands, or its fields as JSON.
    Columns go by name, as in :func:`read_csv_table`.
    """
    raw = _as_text(spark, path).withColumn("_file", F.col("_metadata.file_path"))
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header")
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    bad = ", ".join(
        f"CASE WHEN `{f.name}` IS NOT NULL AND {_cast(f.name, f.dataType)} IS NULL THEN '{f.name}' END"
        for f in typed
    )
    raw = raw.withColumn("_bad", F.expr(f"array_compact(array({bad}))" if typed else "array()"))
    fits = f"`{RECORD}` IS NULL AND size(_bad) = 0"
    good = raw.filter(fits).selectExpr(
        *[f"{_cast(f.name, f.dataType)} AS `{f.name}`" for f in schema.fields]
    )
    fields = ", ".join(f"`{c}`" for c in raw.columns if c not in (RECORD, "_file", "_bad"))
    rejects = raw.filter(f"NOT ({fits})").selectExpr(
        "_file AS file",
        f"'{table}' AS table",
        f"CASE WHEN `{RECORD}` IS NULL THEN _bad ELSE array() END AS columns",
        f"coalesce(`{RECORD}`, to_json(struct({fields}))) AS record",
    )
    return good, rejects


def count_rejects(rejects: DataFrame) -> DataFrame:
    """(table, file, rejected, columns): rejected lines per file, with the columns at fault."""
    return rejects.groupBy("table", "file").agg(
        F.count("*").alias("rejected"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("columns")))).alias("columns"),
    )


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A headered CSV file or folder, matched to ``schema`` by column name.

    Columns are read as text in file order and cast by name, so the column order of the files and
    additional columns do not matter. The header of the first file names the columns; reading fails
    if another file has another header, or at a value that is not of its column's type.
    """
    named = spark.read.option("header", True).csv(path).schema
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(named).csv(path)
    return raw.select(*[raw[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def read_roles(
    spark: SparkSession,
    folder: str,
    fmt: str = "parquet",
    prefix: str = "",
    id_type: T.DataType = _STRING,
) -> Roles:
    """``<folder>/<prefix><table>.<fmt>`` for the five role tables."""
    frames = {}
    for table in TABLES:
        path, schema = f"{folder}/{prefix}{table}.{fmt}", role_schema(table, id_type)
        if fmt == "csv":
            frames[table] = read_csv_table(spark, path, schema)
        else:
            frames[table] = spark.read.format(fmt).load(path).select(*schema.fieldNames())
    return Roles(**frames)


def split_csv_roles(
    spark: SparkSession, folder: str, prefix: str = "", id_type: T.DataType = _STRING
) -> tuple[Roles, DataFrame]:
    """Roles of the lines of CSV files that fit, and the rejects of all five tables."""
    parts = {
        table: split_csv_table(
            spark, f"{folder}/{prefix}{table}.csv", role_schema(table, id_type), table
        )
        for table in TABLES
    }
    rejects = reduce(DataFrame.unionByName, [rejected for _, rejected in parts.values()])
    return Roles(**{table: good for table, (good, _) in parts.items()}), rejects
