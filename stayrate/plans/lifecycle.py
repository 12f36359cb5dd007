"""Account lifecycles and the usage that falls inside them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import bucketize, day, month_of
from stayrate.params import Params
from stayrate.plans.joins import lookup
from stayrate.roles import Roles


# The account column a derived segment is made from.
SEGMENT_SOURCES = {"seat_bucket": "seats", "cohort_month": "signup_date"}


def segment(name: str, params: Params) -> str:
    """SQL text of a column accounts can be cut by, given or derived."""
    if name == "seat_bucket":
        return bucketize("seats", params.seat_edges, params.seat_labels)
    return month_of("signup_date") if name == "cohort_month" else name


def account_span(roles: Roles) -> DataFrame:
    """Accounts with ``churn_date``: the last churn event of an account flagged as churned.

    Events are reduced to one row per account before they meet the accounts.
    """
    latest = roles.churn_events.groupBy("account_id").agg(F.max("churn_date").alias("last_event"))
    return roles.accounts.join(latest, "account_id", "left").selectExpr(
        *roles.accounts.columns, "CASE WHEN churn_flag THEN last_event END AS churn_date"
    )


def owned_usage(
    roles: Roles,
    *measures: str,
    attrs: Sequence[str] = (),
    churn: bool = False,
    since: date | None = None,
    until: date | None = None,
) -> DataFrame:
    """Usage rows with their account, its signup date and ``days`` since signup.

    Subscriptions meet accounts first, so the usage table, by far the largest, is shuffled once, by
    subscription_id; filters on account columns put on the result move down to the accounts.
    ``churn`` adds churn_date, ``attrs`` more account columns. ``since`` and ``until`` bound the
    usage dates at the scan. With a prepared usage table nothing is joined at all, and the bounds
    choose its month folders.
    """
    wanted = ["account_id", "signup_date", *(["churn_date"] if churn else []), *attrs]
    wanted = list(dict.fromkeys(wanted))
    source = roles.feature_usage if roles.owned is None else roles.owned
    for bound, sign in ((since, ">="), (until, "<=")):
        if bound is not None:
            source = source.filter(f"usage_date {sign} {day(bound)}")
            if roles.owned is not None:
                source = source.filter(f"usage_month {sign} {day(bound.replace(day=1))}")
    if roles.owned is not None:
        owned = source.select("usage_date", *measures, *wanted)
    else:
        owner = lookup(
            roles.subscriptions.select("subscription_id", "account_id"),
            (account_span(roles) if churn else roles.accounts).select(wanted),
            "account_id",
            roles.hot("subscriptions", "account_id"),
        )
        usage = source.select("subscription_id", "usage_date", *measures)
        hot = roles.hot("feature_usage", "subscription_id")
        owned = lookup(usage, owner, "subscription_id", hot)
    return owned.withColumn("days", F.datediff("usage_date", "signup_date"))


def in_lifetime(window_end: date | None) -> str:
    """From signup to the last churn date, or to the window end for accounts that stayed.

    Without a window end, accounts that stayed have no upper bound.
    """
    if window_end is None:
        return "(days >= 0 AND (churn_date IS NULL OR usage_date <= churn_date))"
    return f"(days >= 0 AND usage_date <= coalesce(churn_date, {day(window_end)}))"


def feature_column(roles: Roles) -> str:
    """The column of owned usage that leads to the feature name."""
    resolved = roles.features is None or roles.owned is not None
    return "feature_name" if resolved else "feature_key"


def with_feature(usage: DataFrame, roles: Roles) -> DataFrame:
    """Resolve ``feature_key`` to ``feature_name`` where usage does not carry the name itself.

    Usage of a key that ``features`` does not hold stays, with a NULL name.
    """
    if "feature_name" in usage.columns:
        return usage
    hot = roles.hot("feature_usage", "feature_key")
    return lookup(usage, roles.features, "feature_key", hot, "left").drop("feature_key")


# Whether the earliest subscription by (start_date, subscription_id) is a trial.
FIRST_IS_TRIAL = "min_by(is_trial, struct(start_date, subscription_id)) AS first_is_trial"


def mature(params: Params) -> str:
    return f"(signup_date <= {day(params.maturity_cut)})"
