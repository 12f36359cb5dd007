"""A written table of usage rows with their accounts, shared by many operators, and its upkeep."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.functions.columns import day, month_of
from stayrate.plans.files import children, delete_folder, new_folder, read_text, replace_text
from stayrate.plans.lifecycle import account_span, feature_column, owned_usage, with_feature
from stayrate.roles import Roles

MEASURES = ("usage_count", "usage_duration_secs", "error_count", "is_beta_feature")
ATTRIBUTES = ("industry", "country", "referral_source", "plan_tier", "seats", "churn_flag")
SPAN = ("account_id", "signup_date", "churn_date", *ATTRIBUTES)


def prepare_usage(roles: Roles, folder: str | None = None) -> Roles:
    """Join usage to its accounts once and return roles that read the result.

    The table goes to ``folder`` as Parquet by usage month; without one, to a new folder below the
    cluster's checkpoint folder. Rows are rebalanced by month, which splits months that hold many
    rows; buckets by account would spare a shuffle but leave a heavy account in one task.
    """
    spark = roles.accounts.sparkSession
    folder = folder or new_folder(spark, "usage")
    _write_months(_owned_rows(roles), folder)
    _write_spans(roles, folder)
    return roles.but(owned=spark.read.parquet(_usage(folder)))


def update_usage(roles: Roles, folder: str, new_usage: DataFrame) -> tuple[Roles, list[date]]:
    """Bring the table of :func:`prepare_usage` up to date; roles that read it, the months rewritten.

    ``roles`` hold all rows as they are now, ``new_usage`` the usage rows added since, or rows of the
    months in which usage was changed or removed. Rewritten are their months, and those in which an
    account has rows whose dates or attributes differ from when the table was written. A month is
    replaced whole; accounts are noted last, so a run that dies is made good by the next. Changed owners
    of subscriptions and changed feature names need a new table.
    """
    spark = roles.accounts.sparkSession
    before = _spans(spark, folder)
    now = account_span(roles).select(*SPAN)
    changed = (
        now.exceptAll(before).select("account_id").union(before.exceptAll(now).select("account_id"))
    ).distinct()
    old = spark.read.parquet(_usage(folder))
    moved = (
        old.select("account_id", "usage_month")
        .join(changed, "account_id", "left_semi")
        .select("usage_month")
    )
    touched = moved.union(new_usage.selectExpr(f"{month_of('usage_date')} AS usage_month"))
    arrived = changed.join(before, "account_id", "left_anti")
    if not arrived.isEmpty():  # the table has no rows yet of usage that waited for its account
        theirs = roles.subscriptions.join(arrived, "account_id", "left_semi")
        waited = roles.feature_usage.select("subscription_id", "usage_date").join(
            theirs.select("subscription_id"), "subscription_id", "left_semi"
        )
        touched = touched.union(waited.selectExpr(f"{month_of('usage_date')} AS usage_month"))
    months = [row[0] for row in touched.distinct().collect()]
    if months:
        _replace_months(roles, folder, months)
    _write_spans(roles, folder)
    fresh = roles.but(owned=spark.read.schema(old.schema).parquet(_usage(folder)))
    return fresh, sorted(month for month in months if month is not None)


def _usage(folder: str) -> str:
    return f"{folder}/owned_usage"


def _owned_rows(roles: Roles) -> DataFrame:
    owned = owned_usage(roles, feature_column(roles), *MEASURES, attrs=ATTRIBUTES, churn=True)
    return (
        with_feature(owned, roles)
        .drop("subscription_id", "days")
        .withColumn("usage_month", F.expr(month_of("usage_date")))
    )


def _write_months(rows: DataFrame, folder: str, partitions: str = "static") -> None:
    (
        rows.hint("rebalance", F.col("usage_month"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", partitions)
        .partitionBy("usage_month")
        .parquet(_usage(folder))
    )


def _replace_months(roles: Roles, folder: str, months: list[date | None]) -> None:
    """Write the given months anew; one that has no rows any more is removed."""
    spark = roles.accounts.sparkSession
    dates = [month for month in months if month is not None]
    chosen = f"usage_month IN ({', '.join(map(day, dates))})" if dates else "false"
    if None in months:
        chosen = f"({chosen} OR usage_month IS NULL)"
    rows = _owned_rows(roles.but(owned=None)).filter(chosen)
    _write_months(rows, folder, "dynamic")
    filled = {row[0] for row in rows.select("usage_month").distinct().collect()}
    gone = {f"usage_month={month}" for month in dates if month not in filled}
    for name, place, _, is_folder in children(spark, _usage(folder)):
        if is_folder and name in gone:
            delete_folder(spark, place)


def _write_spans(roles: Roles, folder: str) -> None:
    """Accounts as the table holds them, in a folder that a small file names when it is whole."""
    spark = roles.accounts.sparkSession
    path = new_folder(spark, "spans").rsplit("/", 1)[1]
    account_span(roles).select(*SPAN).write.parquet(f"{folder}/{path}")
    before = read_text(spark, f"{folder}/spans")
    replace_text(spark, f"{folder}/spans", path)
    if before:
        delete_folder(spark, f"{folder}/{before}")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    path = read_text(spark, f"{folder}/spans")
    if path is None:
        raise ValueError(f"{folder} holds no prepared usage")
    return spark.read.parquet(f"{folder}/{path}")
