"""Headline accounts, revenue, activity, churn and support numbers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import (
    ERA,
    cols,
    exact_avg,
    exact_sum,
    month_bits,
    month_number,
    month_of,
    months_of_era,
    pct,
    ratio,
    rnd,
)
from stayrate.params import Params
from stayrate.plans.aggregates import monthly
from stayrate.plans.joins import side_by_side
from stayrate.plans.lifecycle import account_span, in_lifetime, owned_usage
from stayrate.roles import Roles

CHURNED_MRR = "CASE WHEN churn_flag THEN mrr_amount ELSE 0 END"
ACTIVE_MRR = "CASE WHEN churn_flag THEN 0 ELSE mrr_amount END"


def kpi_topline(roles: Roles, params: Params) -> DataFrame:
    per_account = roles.subscriptions.groupBy("account_id").agg(
        *cols(
            f"{exact_sum('CASE WHEN NOT churn_flag THEN mrr_amount END')} AS mrr",
            f"{exact_sum('CASE WHEN NOT churn_flag THEN arr_amount END')} AS arr",
            "max(upgrade_flag) AS upgraded",
        )
    )
    row = side_by_side(
        roles.accounts.agg(
            *cols(
                "count(*) AS accounts_total",
                "count_if(churn_flag) AS churned_accounts",
                "count_if(is_trial) AS currently_trialing",
            )
        ),
        per_account.agg(
            *cols(
                f"{rnd(exact_sum('mrr'))} AS mrr_active",
                f"{rnd(exact_sum('arr'))} AS arr_active",
                "count(account_id) FILTER (WHERE upgraded) AS acct_ever_upgraded",
            )
        ),
    )
    return row.selectExpr(
        "accounts_total",
        "churned_accounts",
        f"{pct('churned_accounts', 'accounts_total')} AS account_churn_pct",
        "currently_trialing",
        "mrr_active",
        "arr_active",
        "acct_ever_upgraded",
        f"{pct('acct_ever_upgraded', 'accounts_total')} AS upgrade_rate_pct",
    )


def kpi_monthly_subscriptions(roles: Roles, params: Params) -> DataFrame:
    """New subscriptions and MRR by start month.

    Churned MRR is booked in the month the subscription started, not the month it ended.
    """
    return monthly(
        roles.subscriptions,
        "start_date",
        "count(*) AS new_subs",
        f"{rnd(exact_sum('mrr_amount'))} AS new_mrr",
        f"{rnd(exact_sum(CHURNED_MRR))} AS churned_mrr_same_cohort",
    ).orderBy("month")


def monthly_active_accounts(
    roles: Roles,
    params: Params,
    bounded: bool = True,
    since: date | None = None,
    until: date | None = None,
) -> DataFrame:
    """Accounts with usage per month; ``bounded=False`` keeps usage after churn."""
    return active_per_month(months_seen(roles, params, bounded, since, until))


def months_seen(
    roles: Roles,
    params: Params,
    bounded: bool = True,
    since: date | None = None,
    until: date | None = None,
) -> DataFrame:
    """(account_id, era, seen): a row per account and era of five years, a bit for each month of use."""
    usage = owned_usage(roles, churn=bounded, since=since, until=until)
    return (
        usage.filter(in_lifetime(params.window_end) if bounded else "days >= 0")
        .selectExpr("account_id", f"{month_number('usage_date')} AS m")
        .groupBy("account_id", F.expr(f"m div {ERA} AS era"))
        .agg(F.expr(f"{month_bits(f'm % {ERA}')} AS seen"))
    )


def active_per_month(seen: DataFrame) -> DataFrame:
    """Accounts per month from (account, era, seen) rows."""
    return (
        seen.selectExpr(f"explode({months_of_era('era', 'seen')}) AS month")
        .groupBy("month")
        .agg(F.expr("count(*) AS active_accounts"))
    )


def kpi_monthly_active_accounts(roles: Roles, params: Params, bounded: bool = True) -> DataFrame:
    return monthly_active_accounts(roles, params, bounded).orderBy("month")


def monthly_account_churn(roles: Roles, params: Params, by: str = "event") -> DataFrame:
    """Churned accounts per month.

    ``by='event'`` counts an account in every month it has a churn event, ``by='last'`` only in
    the month of its last one.
    """
    if by == "last":
        span = account_span(roles).filter("churn_date IS NOT NULL")
        return monthly(span, "churn_date", "count(*) AS accounts_churned")
    cells = roles.churn_events.selectExpr(f"{month_of('churn_date')} AS month", "account_id")
    churned = roles.accounts.filter("churn_flag").select("account_id")
    return (
        cells.distinct()
        .join(churned, "account_id")
        .groupBy("month")
        .agg(F.expr("count(*) AS accounts_churned"))
    )


def kpi_monthly_account_churn(roles: Roles, params: Params, by: str = "event") -> DataFrame:
    return monthly_account_churn(roles, params, by).orderBy("month")


def kpi_expansion_contraction(roles: Roles, params: Params) -> DataFrame:
    changes = roles.subscriptions.groupBy("account_id").agg(
        *cols("max(upgrade_flag) AS up", "max(downgrade_flag) AS down")
    )
    return changes.agg(
        *cols(
            "count(*) AS accounts",
            "count_if(up) AS any_upgrade",
            "count_if(down) AS any_downgrade",
            "count_if(up AND down) AS both",
        )
    )


def kpi_mrr_by_plan(roles: Roles, params: Params) -> DataFrame:
    return (
        roles.subscriptions.groupBy("plan_tier")
        .agg(
            *cols(
                f"{rnd(exact_sum(ACTIVE_MRR))} AS active_mrr",
                f"{rnd(exact_sum(CHURNED_MRR))} AS churned_mrr",
            )
        )
        .orderBy(F.desc("active_mrr"), "plan_tier")
    )


def kpi_support_load(roles: Roles, params: Params) -> DataFrame:
    row = side_by_side(
        roles.tickets.agg(
            *cols(
                "count(*) AS tickets",
                f"{rnd(exact_avg('resolution_time_hours'), 1)} AS avg_res_h",
                f"{rnd(exact_avg('first_response_time_minutes'))} AS avg_frt_min",
                f"{rnd(exact_avg('satisfaction_score'), 2)} AS avg_csat",
                f"{pct('count_if(escalation_flag)', 'count(*)')} AS esc_pct",
            )
        ),
        roles.accounts.agg(F.expr("count(*) AS accounts")),
    )
    return row.selectExpr(
        "tickets",
        f"{rnd(ratio('tickets', 'accounts'), 2)} AS tickets_per_acct",
        "avg_res_h",
        "avg_frt_min",
        "avg_csat",
        "esc_pct",
    )
