"""Role tables derived from an order-entry star schema.

Customers act as accounts, orders as subscriptions, order lines as feature usage, returned lines as
support tickets and fulfilled orders as churn events.
"""

from __future__ import annotations

from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.params import Params
from stayrate.plans.joins import lookup
from stayrate.roles import Roles

PARAMS = Params(
    window_start=date(1995, 1, 1),
    window_end=date(2001, 8, 1),
    cohort_cut=date(1996, 1, 1),
    maturity_cut=date(2001, 2, 1),
)
CHURNED_BEFORE = date(2000, 8, 1)
# All prices of these tables have two decimal places, so this is the same number.
PRICE = "CAST(o_totalprice AS DECIMAL(18, 2))"


# Columns of the order-entry tables. Reading with them opens no file while planning.
SCHEMAS = {
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
}


def _accounts(
    customer: DataFrame, orders: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    active = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(day).alias("signup_date"), F.max(day).alias("last_order")
    )
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name"
    )
    key = F.col("c_custkey")
    return (
        customer.join(active, "c_custkey")
        .join(place, "c_nationkey")
        .select(
            key.alias("account_id"),
            F.when(key % 50 != 7, F.col("c_name")).alias("account_name"),
            F.col("c_mktsegment").alias("industry"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("referral_source"),
            "signup_date",
            F.when(F.col("c_acctbal") < 2000, "Basic")
            .when(F.col("c_acctbal") < 6000, "Pro")
            .otherwise("Enterprise")
            .alias("plan_tier"),
            F.when(key % 97 != 11, (key % 80 + 1).cast("int")).alias("seats"),
            (key % 5 == 3).alias("is_trial"),
            (F.col("last_order") < F.lit(CHURNED_BEFORE)).alias("churn_flag"),
        )
    )


def _subscriptions(orders: DataFrame) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    closed = F.col("o_orderstatus") == "F"
    priority = F.col("o_orderpriority")
    return orders.select(
        key.alias("subscription_id"),
        F.col("o_custkey").alias("account_id"),
        day.alias("start_date"),
        F.when(closed, F.date_add(day, (key % 365 - 5).cast("int"))).alias("end_date"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "Enterprise")
        .when(priority == "5-LOW", "Basic")
        .otherwise("Pro")
        .alias("plan_tier"),
        F.when(key % 3 == 0, "annual").otherwise("monthly").alias("billing_frequency"),
        F.expr(PRICE).alias("mrr_amount"),
        F.expr(f"12 * {PRICE}").alias("arr_amount"),
        closed.alias("churn_flag"),
        (F.col("o_orderstatus") == "P").alias("is_trial"),
        (key % 7 == 0).alias("upgrade_flag"),
        (key % 11 == 0).alias("downgrade_flag"),
        (key % 5 != 0).alias("auto_renew_flag"),
    )


def _feature_usage(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("usage_id"),
        F.col("l_orderkey").alias("subscription_id"),
        F.col("l_partkey").alias("feature_key"),
        F.col("l_shipdate").cast("date").alias("usage_date"),
        F.col("l_quantity").cast("bigint").alias("usage_count"),
        F.floor("l_extendedprice").cast("bigint").alias("usage_duration_secs"),
        (F.col("l_returnflag") == "R").cast("int").alias("error_count"),
        (F.col("l_linestatus") == "O").alias("is_beta_feature"),
    )


def _support_tickets(returned: DataFrame) -> DataFrame:
    hours = F.col("l_quantity")
    return returned.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ticket_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("l_shipdate").alias("submitted_at"),
        F.when(
            hours < 48, F.col("l_shipdate") + F.make_dt_interval(hours=hours.cast("int"))
        ).alias("closed_at"),
        hours.alias("resolution_time_hours"),
        (F.col("l_tax") * 1000).alias("first_response_time_minutes"),
        F.when(F.col("l_discount") >= 0.05, F.col("l_discount") * 50).alias("satisfaction_score"),
        F.when(hours >= 48, "urgent").when(hours >= 25, "high").otherwise("low").alias("priority"),
        (hours >= 48).alias("escalation_flag"),
    )


def _churn_events(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.filter("o_orderstatus = 'F'").select(
        key.alias("churn_event_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("churn_date"),
        F.col("o_orderpriority").alias("reason_code"),
        F.when(key % 4 != 0, "text").alias("feedback_text"),
        F.expr(f"CASE WHEN o_orderkey % 6 = 0 THEN {PRICE} * 0.1BD ELSE 0.0BD END").alias(
            "refund_amount_usd"
        ),
        (key % 10 == 0).alias("is_reactivation"),
    )


def retail_roles(spark: SparkSession, folder: str, **options) -> Roles:
    """Roles over ``<folder>/<table>.parquet``, made when needed; ``options`` go to Roles."""

    @cache
    def t(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")

    def tickets(roles: Roles) -> DataFrame:
        owners = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        returned = t("lineitem").filter("l_returnflag = 'R' AND l_linestatus = 'F'")
        hot = roles.hot("feature_usage", "subscription_id")
        return _support_tickets(lookup(returned, owners, "l_orderkey", hot))

    return Roles(
        accounts=lambda _: _accounts(*map(t, ("customer", "orders", "nation", "region"))),
        subscriptions=lambda _: _subscriptions(t("orders")),
        feature_usage=lambda _: _feature_usage(t("lineitem")),
        support_tickets=tickets,
        churn_events=lambda _: _churn_events(t("orders")),
        features=lambda _: t("part").select(
            F.col("p_partkey").alias("feature_key"), F.col("p_brand").alias("feature_name")
        ),
        **options,
    )
