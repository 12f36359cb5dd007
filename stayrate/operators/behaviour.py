"""Usage, feature, error and support behaviour against churn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import cols, exact_avg, pct, rnd, text, within
from stayrate.params import Params
from stayrate.plans.aggregates import rate_by
from stayrate.plans.lifecycle import (
    account_span,
    feature_column,
    in_lifetime,
    mature,
    owned_usage,
    with_feature,
)
from stayrate.roles import Roles

MEASURES = ("usage_count", "usage_duration_secs", "error_count", "is_beta_feature")


def lifetime_usage(
    roles: Roles, params: Params, *measures: str, open_end: bool = False
) -> DataFrame:
    """Usage between signup and churn, with churn_flag; ``open_end`` drops the window end."""
    usage = owned_usage(roles, *measures, attrs=["churn_flag"], churn=True)
    return usage.filter(in_lifetime(None if open_end else params.window_end))


def behaviour_usage_by_outcome(roles: Roles, params: Params, open_end: bool = False) -> DataFrame:
    """Per-account usage totals averaged over churned and kept accounts that have usage.

    Rows are first summed per account and feature, which leaves distinct features to a count.
    """
    usage = with_feature(
        lifetime_usage(roles, params, feature_column(roles), *MEASURES, open_end=open_end), roles
    )
    per_feature = usage.groupBy("account_id", "churn_flag", "feature_name").agg(
        *cols(
            "count(*) AS events",
            "sum(usage_count) AS uses",
            "sum(usage_duration_secs) AS secs",
            "sum(error_count) AS errors",
            "count_if(is_beta_feature) AS beta",
        )
    )
    sums = [f"sum({c}) AS {c}" for c in ("events", "uses", "secs", "errors", "beta")]
    per_account = per_feature.groupBy("account_id", "churn_flag").agg(
        *cols("count(feature_name) AS features", *sums)
    )
    return (
        per_account.groupBy("churn_flag")
        .agg(
            *cols(
                "count(*) AS accounts",
                f"{rnd('avg(events)', 1)} AS avg_events",
                f"{rnd('avg(features)', 1)} AS avg_feats",
                f"{rnd('avg(uses)')} AS avg_usage_count",
                f"{rnd('avg(secs) / 3600D', 1)} AS avg_hours_used",
                f"{rnd('avg(errors)', 1)} AS avg_errors",
                f"{rnd('avg(beta)', 1)} AS avg_beta",
            )
        )
        .orderBy("churn_flag")
    )


def _window_name(window: tuple[int, int]) -> str:
    lo, hi = window
    return f"last_{hi}d" if lo == 0 else f"d{lo}_{hi}"


def behaviour_prechurn_windows(roles: Roles, params: Params) -> DataFrame:
    """Mean usage_count per usage row in day windows before the last churn date."""
    usage = (
        owned_usage(roles, "usage_count", churn=True)
        .filter("days >= 0 AND usage_date <= churn_date")
        .selectExpr("usage_count", "datediff(churn_date, usage_date) AS before")
    )
    means = [
        f"{rnd(f'avg(usage_count) FILTER (WHERE {within('before', w)})', 1)}"
        f" AS avg_count_{_window_name(w)}"
        for w in params.prechurn_windows
    ]
    return usage.agg(*cols(*means))


def feature_adoption(roles: Roles, params: Params, bounded: bool = False) -> DataFrame:
    """Per feature: mature adopters, churned ones, and the same for all mature accounts.

    ``bounded`` leaves usage after churn out.

    Non-adopters are the totals minus the adopters, so features never meet accounts pairwise. A
    feature used in the window only by accounts that are not mature stays, with 0 adopters.
    """
    usage = owned_usage(roles, feature_column(roles), attrs=["churn_flag"], churn=bounded)
    if bounded:
        usage = usage.filter(in_lifetime(params.window_end))
    adopted = with_feature(usage.filter(within("days", params.adoption_window)), roles)
    adopted = adopted.filter("feature_name IS NOT NULL")
    pairs = adopted.selectExpr(
        "feature_name", "account_id", "churn_flag", f"{mature(params)} AS mature"
    ).distinct()
    base = (
        roles.accounts.filter(mature(params))
        .agg(F.expr("struct(count(*) AS n, count_if(churn_flag) AS lost)"))
        .scalar()
    )
    return (
        pairs.groupBy("feature_name")
        .agg(
            *cols(
                "count_if(mature) AS adopters",
                "count_if(mature AND churn_flag) AS adopters_lost",
            )
        )
        .withColumn("base", base)
        .selectExpr(
            "feature_name",
            "adopters",
            "adopters_lost",
            "base.n - adopters AS others",
            "base.lost - adopters_lost AS others_lost",
        )
    )


def adoption_rates(roles: Roles, params: Params, bounded: bool = False) -> DataFrame:
    return feature_adoption(roles, params, bounded).selectExpr(
        "feature_name",
        "adopters",
        f"{pct('adopters_lost', 'adopters')} AS adopter_churn_pct",
        f"{pct('others_lost', 'others')} AS nonadopter_churn_pct",
    )


GAP = rnd("adopter_churn_pct - nonadopter_churn_pct", 1)


def behaviour_feature_adoption(
    roles: Roles, params: Params, bounded: bool = False
) -> DataFrame:
    """The features whose adopters churn least against the others."""
    return (
        adoption_rates(roles, params, bounded)
        .orderBy(F.expr(GAP).asc_nulls_last(), "feature_name")
        .limit(params.feature_limit)
    )


def behaviour_feature_adoption_extremes(roles: Roles, params: Params, k: int = 3) -> DataFrame:
    """The ``k`` features with the lowest and with the highest gap."""
    rates = adoption_rates(roles, params).withColumn("delta", F.expr(GAP))
    rates = rates.filter("delta IS NOT NULL")
    lowest = rates.orderBy("delta", "feature_name").limit(k)
    highest = rates.orderBy(F.desc("delta"), "feature_name").limit(k)
    return lowest.selectExpr(f"{text('lowest')} AS side", "*").unionByName(
        highest.selectExpr(f"{text('highest')} AS side", "*")
    )


def behaviour_error_rate(roles: Roles, params: Params) -> DataFrame:
    per_account = (
        lifetime_usage(roles, params, "error_count", "usage_count")
        .groupBy("account_id", "churn_flag")
        .agg(*cols("sum(error_count) AS errors", "sum(usage_count) AS uses"))
    )
    return (
        per_account.groupBy("churn_flag")
        .agg(
            *cols(
                f"{rnd('avg(errors)', 1)} AS avg_errors",
                f"{pct('sum(errors)', 'sum(uses)', 2)} AS errs_per_100_usage",
            )
        )
        .orderBy("churn_flag")
    )


def ticket_stats(roles: Roles) -> DataFrame:
    return roles.tickets.groupBy("account_id").agg(
        *cols(
            "count(*) AS tickets",
            f"{exact_avg('resolution_time_hours')} AS res_h",
            f"{exact_avg('first_response_time_minutes')} AS frt_min",
            f"{exact_avg('satisfaction_score')} AS csat",
            "count_if(escalation_flag) AS escs",
        )
    )


def behaviour_support_by_outcome(
    roles: Roles, params: Params, only_ticketed: bool = False
) -> DataFrame:
    """Support per account, churned against kept.

    Accounts without tickets count as accounts and stay out of the averages; ``only_ticketed``
    leaves them out of the account counts too.
    """
    how = "inner" if only_ticketed else "left"
    joined = roles.accounts.select("account_id", "churn_flag").join(
        ticket_stats(roles), "account_id", how
    )
    return (
        joined.groupBy("churn_flag")
        .agg(
            *cols(
                "count(*) AS accts",
                f"{rnd('avg(tickets)', 2)} AS avg_tickets",
                f"{rnd(exact_avg('res_h'), 1)} AS avg_resolution_h",
                f"{rnd(exact_avg('frt_min'), 1)} AS avg_first_response_min",
                f"{rnd(exact_avg('csat'), 2)} AS avg_csat",
                f"{rnd('avg(escs)', 2)} AS avg_escalations",
                f"{pct('count_if(escs > 0)', 'count(*)')} AS pct_accts_escalated",
            )
        )
        .orderBy("churn_flag")
    )


def behaviour_escalations_before_churn(roles: Roles, params: Params) -> DataFrame:
    """Escalated tickets by distance to the last churn date, counted per account and day first."""
    per_day = (
        roles.tickets.filter("escalation_flag")
        .groupBy("account_id", F.expr("CAST(submitted_at AS DATE) AS day"))
        .agg(F.expr("count(*) AS n"))
    )
    churned = (
        account_span(roles).filter("churn_date IS NOT NULL").select("account_id", "churn_date")
    )
    rows = per_day.join(churned, "account_id").selectExpr(
        "n", "datediff(churn_date, day) AS before"
    )
    windows = [
        f"coalesce(sum(n) FILTER (WHERE {within('before', w)}), 0) AS esc_{_window_name(w)}"
        for w in params.prechurn_windows[:2]
    ]
    return rows.filter("before >= 0").agg(
        *cols(*windows, "coalesce(sum(n), 0) AS esc_total_pre_churn")
    )


def behaviour_beta_usage(roles: Roles, params: Params) -> DataFrame:
    used = (
        lifetime_usage(roles, params, "is_beta_feature")
        .groupBy("account_id", "churn_flag")
        .agg(F.expr("max(is_beta_feature) AS beta"))
    )
    return (
        rate_by(used, ["churn_flag"], "beta", rate="pct_used_beta")
        .select("churn_flag", "pct_used_beta")
        .orderBy("churn_flag")
    )
