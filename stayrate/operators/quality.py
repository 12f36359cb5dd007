"""Checks on keys, references, dates, nulls and domains of the role tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import cols, pct, rnd, text
from stayrate.params import Params
from stayrate.plans.aggregates import exact_median
from stayrate.plans.joins import side_by_side
from stayrate.plans.lifecycle import owned_usage
from stayrate.roles import TABLES, Roles

# Keys, references with their labels, columns that may be NULL, listed domains.
KEYS = {
    "accounts": "account_id",
    "subscriptions": "subscription_id",
    "feature_usage": "usage_id",
    "support_tickets": "ticket_id",
    "churn_events": "churn_event_id",
}
REFERENCES = (
    ("usage -> subscriptions", "feature_usage", "subscriptions", "subscription_id"),
    ("subscriptions -> accounts", "subscriptions", "accounts", "account_id"),
    ("tickets -> accounts", "support_tickets", "accounts", "account_id"),
    ("churn_events -> accounts", "churn_events", "accounts", "account_id"),
)
NULLABLE = {
    "accounts": ("account_name", "seats", "signup_date"),
    "subscriptions": ("arr_amount", "mrr_amount", "end_date"),
    "support_tickets": ("satisfaction_score", "closed_at", "resolution_time_hours"),
    "churn_events": ("feedback_text", "reason_code", "churn_date"),
}
DOMAINS = {
    "accounts": ("industry", "referral_source", "plan_tier"),
    "churn_events": ("reason_code",),
    "subscriptions": ("billing_frequency",),
    "support_tickets": ("priority",),
}


def _stack(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def dq_row_counts(roles: Roles, params: Params) -> DataFrame:
    return _stack(
        roles.table(t).agg(*cols(f"{text(t)} AS tbl", "count(*) AS rows")) for t in TABLES
    ).orderBy("tbl")


def dq_key_uniqueness(roles: Roles, params: Params) -> DataFrame:
    return _stack(
        roles.table(t).agg(
            *cols(
                f"{text(f'{t}.{k}')} AS key",
                "count(*) AS n",
                f"count(DISTINCT {k}) AS distinct_n",
            )
        )
        for t, k in KEYS.items()
    ).orderBy("key")


def dq_fk_orphans(roles: Roles, params: Params) -> DataFrame:
    """Child rows whose key is NULL or absent from the parent.

    Children are counted per key before the anti join, so a hot key is one row there.
    """
    return _stack(
        roles.table(child)
        .groupBy(key)
        .agg(F.expr("count(*) AS n"))
        .join(roles.table(parent).select(key), key, "left_anti")
        .agg(*cols(f"{text(name)} AS fk", "coalesce(sum(n), 0) AS orphans"))
        for name, child, parent, key in REFERENCES
    )


def dq_duplicate_keys(roles: Roles, params: Params) -> DataFrame:
    return (
        roles.feature_usage.groupBy("usage_id")
        .agg(F.expr("count(*) AS n"))
        .filter("n > 1")
        .orderBy(F.desc("n"), "usage_id")
    )


def _extent(df: DataFrame, column: str, name: str, *more: str) -> DataFrame:
    return df.agg(*cols(f"min({column}) AS min_{name}", f"max({column}) AS max_{name}", *more))


def dq_date_extents(roles: Roles, params: Params) -> DataFrame:
    return side_by_side(
        _extent(roles.accounts, "signup_date", "signup"),
        _extent(roles.feature_usage, "usage_date", "usage"),
        _extent(roles.churn_events, "churn_date", "churn"),
    )


def dq_date_extents_cross(roles: Roles, params: Params) -> DataFrame:
    """Signup and churn extents that the reference takes from a product of the two tables.

    As there, all four are NULL when either table is empty.
    """
    both = side_by_side(
        _extent(roles.accounts, "signup_date", "signup", "count(*) AS accounts"),
        _extent(roles.churn_events, "churn_date", "churn", "count(*) AS events"),
    )
    names = ("min_signup", "max_signup", "min_churn", "max_churn")
    return both.selectExpr(
        *[f"CASE WHEN accounts > 0 AND events > 0 THEN {c} END AS {c}" for c in names]
    )


def dq_bad_ranges(roles: Roles, params: Params) -> DataFrame:
    return roles.subscriptions.agg(F.expr("count_if(end_date < start_date) AS bad_ranges"))


def dq_churn_before_signup(roles: Roles, params: Params) -> DataFrame:
    per_day = roles.churn_events.groupBy("account_id", "churn_date").agg(F.expr("count(*) AS n"))
    return (
        per_day.join(roles.accounts.select("account_id", "signup_date"), "account_id")
        .filter("churn_date < signup_date")
        .agg(F.expr("coalesce(sum(n), 0) AS churn_before_signup"))
    )


def dq_null_profile(roles: Roles, params: Params) -> DataFrame:
    def profile(table: str, columns: tuple[str, ...]) -> DataFrame:
        counts = roles.table(table).agg(*cols(*[f"count_if({c} IS NULL) AS {c}" for c in columns]))
        cells = ", ".join(f"struct({text(c)} AS column, {c} AS nulls)" for c in columns)
        return counts.selectExpr(f"{text(table)} AS tbl", f"inline(array({cells}))")

    return _stack(profile(t, columns) for t, columns in NULLABLE.items())


def dq_domains(roles: Roles, params: Params) -> DataFrame:
    """Distinct values of the categorical columns, in one pass per table."""

    def values(table: str, columns: tuple[str, ...]) -> DataFrame:
        cells = ", ".join(f"struct({text(c)} AS column, {c} AS value)" for c in columns)
        rows = roles.table(table).selectExpr(f"{text(table)} AS tbl", f"inline(array({cells}))")
        return rows.distinct()

    return _stack(values(t, c) for t, c in DOMAINS.items()).orderBy(
        "tbl", "column", F.asc_nulls_last("value")
    )


def dq_churn_definitions(roles: Roles, params: Params) -> DataFrame:
    """The three counts called churn, and the reactivations among the events."""
    return side_by_side(
        roles.accounts.agg(F.expr("count_if(churn_flag) AS account_churn")),
        roles.subscriptions.agg(F.expr("count_if(churn_flag) AS subscription_churn")),
        roles.churn_events.agg(
            *cols("count(*) AS churn_event_rows", "count_if(is_reactivation) AS reactivations")
        ),
    )


def dq_churn_definition_rates(roles: Roles, params: Params) -> DataFrame:
    """The same three definitions as percentages of accounts or subscriptions."""
    counts = side_by_side(
        roles.accounts.agg(*cols("count(churn_flag) AS accounts", "count_if(churn_flag) AS lost")),
        roles.subscriptions.agg(
            *cols("count(churn_flag) AS subs", "count_if(churn_flag) AS subs_lost")
        ),
        roles.churn_events.agg(F.expr("count(DISTINCT account_id) AS with_event")),
    )
    return counts.selectExpr(
        f"{pct('lost', 'accounts')} AS account_churn_pct",
        f"{pct('subs_lost', 'subs')} AS subscription_churn_pct",
        f"{pct('with_event', 'accounts')} AS accounts_with_event_pct",
    )


def _rows_and_accounts(usage: DataFrame, rows: str, accounts: str) -> DataFrame:
    per_account = usage.groupBy("account_id").agg(F.expr("count(*) AS n"))
    return per_account.agg(*cols(f"coalesce(sum(n), 0) AS {rows}", f"count(*) AS {accounts}"))


def dq_usage_after_churn(roles: Roles, params: Params) -> DataFrame:
    late = owned_usage(roles, churn=True).filter("usage_date > churn_date")
    return _rows_and_accounts(late, "events_after_churn", "accounts_affected")


def dq_usage_before_signup(roles: Roles, params: Params) -> DataFrame:
    early = owned_usage(roles).filter("days < 0")
    return _rows_and_accounts(early, "events_before_signup", "accounts")


def dq_numeric_distribution(roles: Roles, params: Params) -> DataFrame:
    seats = roles.accounts.selectExpr("seats", "true AS every")
    return side_by_side(
        seats.agg(
            *cols(
                "min(seats) AS min_seats",
                "max(seats) AS max_seats",
                f"{rnd('avg(seats)', 1)} AS avg_seats",
            )
        ),
        exact_median(seats, "seats", "every").agg(
            F.expr(f"{rnd('max(median)', 1)} AS median_seats")
        ),
    )
