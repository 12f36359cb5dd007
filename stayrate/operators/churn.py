"""Where churn concentrates, what it costs and what customers say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import cols, exact_avg, exact_sum, pct, rnd, text
from stayrate.params import Params
from stayrate.plans.aggregates import rate_by
from stayrate.plans.lifecycle import segment
from stayrate.roles import Roles


def churn_by(roles: Roles, params: Params, by: str, digits: int = 1) -> DataFrame:
    accounts = roles.accounts.selectExpr("churn_flag", f"{segment(by, params)} AS {by}")
    return rate_by(accounts, [by], "churn_flag", n="accounts", digits=digits).orderBy(
        F.desc("churn_pct"), F.asc_nulls_last(by)
    )


def churn_by_industry(roles: Roles, params: Params) -> DataFrame:
    return churn_by(roles, params, "industry")


def churn_by_source(roles: Roles, params: Params) -> DataFrame:
    return churn_by(roles, params, "referral_source")


def churn_by_seat_bucket(roles: Roles, params: Params) -> DataFrame:
    return churn_by(roles, params, "seat_bucket", digits=2)


def churn_by_plan(roles: Roles, params: Params) -> DataFrame:
    return churn_by(roles, params, "plan_tier").drop("churned")


def churn_industry_x_source(roles: Roles, params: Params) -> DataFrame:
    """Crosses with at least ``min_n`` accounts, highest churn first; ties break by name."""
    cells = rate_by(roles.accounts, ["industry", "referral_source"], "churn_flag")
    return (
        cells.filter(f"n >= {params.min_n}")
        .drop("churned")
        .orderBy(
            F.desc("churn_pct"),
            F.asc_nulls_last("industry"),
            F.asc_nulls_last("referral_source"),
        )
        .limit(params.cross_limit)
    )


def lost_revenue(roles: Roles) -> DataFrame:
    """Churned subscriptions per plan with exact MRR and ARR."""
    return (
        roles.subscriptions.filter("churn_flag")
        .groupBy("plan_tier")
        .agg(
            *cols(
                "count(*) AS churned_subs",
                f"{exact_sum('mrr_amount')} AS mrr",
                f"{exact_sum('arr_amount')} AS arr",
            )
        )
    )


def churn_revenue_by_plan(roles: Roles, params: Params) -> DataFrame:
    lost = lost_revenue(roles)
    total = lost.agg(F.expr(exact_sum("arr"))).scalar()
    return (
        lost.withColumn("total", total)
        .selectExpr(
            "plan_tier",
            "churned_subs",
            f"{rnd('mrr')} AS mrr_lost",
            f"{rnd('arr')} AS arr_lost",
            f"{pct('arr', 'total')} AS share_of_arr_lost_pct",
        )
        .orderBy(F.desc("arr_lost"), "plan_tier")
    )


def churn_arr_by_industry(roles: Roles, params: Params) -> DataFrame:
    """ARR on churned subscriptions per industry, summed per account before meeting accounts."""
    per_account = (
        roles.subscriptions.filter("churn_flag")
        .groupBy("account_id")
        .agg(F.expr(f"{exact_sum('arr_amount')} AS arr"))
    )
    return (
        per_account.join(roles.accounts.select("account_id", "industry"), "account_id")
        .groupBy("industry")
        .agg(*cols(f"{rnd(exact_sum('arr'))} AS arr_lost", "count(*) AS accts_losing"))
        .orderBy(F.desc("arr_lost"), "industry")
    )


def churn_reasons(roles: Roles, params: Params) -> DataFrame:
    counts = roles.churn_events.groupBy("reason_code").agg(F.expr("count(*) AS events"))
    total = counts.agg(F.sum("events")).scalar()
    return (
        counts.withColumn("total", total)
        .selectExpr("reason_code", "events", f"{pct('events', 'total')} AS pct")
        .orderBy(F.desc("events"), "reason_code")
    )


def reason_counts(roles: Roles) -> DataFrame:
    """Events per (account plan, reason), counted per account before meeting accounts."""
    per_account = roles.churn_events.groupBy("account_id", "reason_code").agg(
        F.expr("count(*) AS n")
    )
    return (
        per_account.join(roles.accounts.select("account_id", "plan_tier"), "account_id")
        .groupBy("plan_tier", "reason_code")
        .agg(F.expr("sum(n) AS events"))
    )


def churn_reasons_by_plan(roles: Roles, params: Params) -> DataFrame:
    return reason_counts(roles).orderBy("plan_tier", F.desc("events"), "reason_code")


PLANS = ("Basic", "Pro", "Enterprise")


def churn_reason_mix_by_plan(
    roles: Roles, params: Params, reasons: Sequence[str], plans: Sequence[str] = PLANS
) -> DataFrame:
    """Plan by reason matrix, each row in percent; one column per entry of ``reasons``.

    ``unlisted`` holds the reasons that are not listed, so a row reaches 100 but for rounding. Events
    without a reason are left out.
    """
    matrix = (
        reason_counts(roles)
        .filter(F.col("plan_tier").isin(*plans))
        .groupBy("plan_tier")
        .agg(
            *cols(
                "sum(events) FILTER (WHERE reason_code IS NOT NULL) AS total",
                *[
                    f"coalesce(sum(events) FILTER (WHERE reason_code = {text(reason)}), 0) AS r{i}"
                    for i, reason in enumerate(reasons)
                ],
            )
        )
        .withColumn("rest", F.expr(" - ".join(["total", *(f"r{i}" for i in range(len(reasons)))])))
    )
    order = F.array_position(F.array(*[F.lit(plan) for plan in plans]), F.col("plan_tier"))
    shares = [f"{pct(f'r{i}', 'total')} AS `{reason}`" for i, reason in enumerate(reasons)]
    rest = f"{pct('rest', 'total')} AS unlisted"
    return matrix.orderBy(order).selectExpr("plan_tier", *shares, rest)


def churn_refunds(roles: Roles, params: Params) -> DataFrame:
    return roles.churn_events.agg(
        *cols(
            "count(*) AS events",
            "count_if(refund_amount_usd > 0) AS with_refund",
            f"{rnd(exact_avg('refund_amount_usd'), 2)} AS avg_refund",
            f"{rnd('max(refund_amount_usd)', 2)} AS max_refund",
        )
    )


def churn_billing_behaviour(roles: Roles, params: Params) -> DataFrame:
    return (
        rate_by(
            roles.subscriptions,
            ["churn_flag", "billing_frequency"],
            "auto_renew_flag",
            n="subs",
            flagged="renewing",
            rate="auto_renew_pct",
        )
        .drop("renewing")
        .orderBy("churn_flag", "billing_frequency")
    )
