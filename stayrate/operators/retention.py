"""Activity retention by signup cohort or segment, and tenure at churn."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import (
    cols,
    day,
    has_bit,
    month_bits,
    month_index,
    month_of,
    pct,
    ratio,
    rnd,
)
from stayrate.params import Params
from stayrate.plans.aggregates import exact_median
from stayrate.plans.joins import side_by_side
from stayrate.plans.lifecycle import (
    SEGMENT_SOURCES,
    account_span,
    in_lifetime,
    owned_usage,
    segment,
)
from stayrate.roles import Roles

ALL_MONTHS = tuple(range(12))


def activity_end(cohort_cut: date, months: Sequence[int]) -> date:
    """First day that lies past the last wanted month of every cohort before ``cohort_cut``."""
    last_signup = cohort_cut - timedelta(days=1)
    month = last_signup.year * 12 + last_signup.month + max(months)
    return date(month // 12, month % 12 + 1, 1)


def retention_counts(
    roles: Roles,
    params: Params,
    by: str,
    months: Sequence[int] = ALL_MONTHS,
    bounded: bool = True,
) -> DataFrame:
    """Cohort size ``n`` and active accounts ``a<k>`` for each month index, one row per segment.

    Activity is reduced to one row per account, a bit for each month index, before any shuffle. Size
    rows and activity rows are stacked and aggregated together, so a segment nobody was active in
    keeps its row and its zeros. Usage past the last month of the last cohort is left out where it is
    scanned. Month indexes are below 63.
    """
    cut = f"signup_date < {day(params.cohort_cut)}"
    end = activity_end(params.cohort_cut, months) - timedelta(days=1)
    label = f"{segment(by, params)} AS {by}"
    source = SEGMENT_SOURCES.get(by, by)
    usage = owned_usage(roles, attrs=[source], churn=bounded, until=end).filter(cut)
    if bounded:
        usage = usage.filter(in_lifetime(params.window_end))
    active = (
        usage.selectExpr("account_id", label, f"{month_index('signup_date', 'usage_date')} AS mi")
        .filter(f"mi IN ({', '.join(map(str, months))})")
        .groupBy("account_id", by)
        .agg(F.expr(f"{month_bits('mi')} AS seen"))
    )
    sizes = roles.accounts.filter(cut).selectExpr(label, "CAST(NULL AS BIGINT) AS seen")
    counts = [f"count_if({has_bit('seen', k)}) AS a{k}" for k in months]
    return (
        sizes.unionByName(active.select(by, "seen"))
        .groupBy(by)
        .agg(*cols("count_if(seen IS NULL) AS n", *counts))
    )


def retention_wide(
    roles: Roles,
    params: Params,
    by: str,
    months: Sequence[int] = ALL_MONTHS,
    bounded: bool = True,
    size: str = "n",
) -> DataFrame:
    counts = retention_counts(roles, params, by, months, bounded)
    shares = [f"{pct(f'a{k}', 'n', 0)} AS m{k}" for k in months]
    return counts.selectExpr(by, f"n AS {size}", *shares).orderBy(F.asc_nulls_last(by))


def retention_long(
    roles: Roles,
    params: Params,
    by: str,
    months: Sequence[int] = ALL_MONTHS,
    bounded: bool = True,
) -> DataFrame:
    """One row per segment and month index, empty cells included as zero."""
    return long_cells(retention_counts(roles, params, by, months, bounded), by, months)


def long_cells(counts: DataFrame, by: str, months: Sequence[int] = ALL_MONTHS) -> DataFrame:
    """One row per cell of a frame of counts ``n`` and ``a<k>`` per segment."""
    cells = ", ".join(f"struct({k} AS month_index, a{k} AS active)" for k in months)
    return counts.selectExpr(by, "n", f"inline(array({cells}))").selectExpr(
        "*", f"{ratio('active', 'n')} AS pct_active"
    )


def retention_cohort_matrix(roles: Roles, params: Params, bounded: bool = True) -> DataFrame:
    return retention_wide(roles, params, "cohort_month", bounded=bounded, size="cohort_size")


def retention_by_source(roles: Roles, params: Params, bounded: bool = True) -> DataFrame:
    return retention_wide(roles, params, "referral_source", (0, 1, 2, 3, 6, 9, 11), bounded)


def retention_by_industry(roles: Roles, params: Params, bounded: bool = True) -> DataFrame:
    return retention_wide(roles, params, "industry", (0, 3, 6, 9, 11), bounded)


def retention_by_seat_bucket(roles: Roles, params: Params, bounded: bool = True) -> DataFrame:
    return retention_wide(roles, params, "seat_bucket", (0, 6, 11), bounded)


def retention_curve_long(
    roles: Roles, params: Params, by: str = "referral_source", bounded: bool = True
) -> DataFrame:
    share = f"{rnd('100D * pct_active', 1)} AS pct_active"
    return (
        retention_long(roles, params, by, bounded=bounded)
        .selectExpr(by, "month_index", "n", "active", share)
        .orderBy(by, "month_index")
    )


def retention_tenure_at_churn(roles: Roles, params: Params) -> DataFrame:
    tenure = (
        account_span(roles)
        .filter("churn_date IS NOT NULL")
        .selectExpr("datediff(churn_date, signup_date) AS days", "true AS every")
    )
    within = [
        (f"{pct(f'count_if(days <= {mark})', 'count(*)')}", f"pct_within_{mark}d")
        for mark in params.tenure_marks
    ]
    row = side_by_side(
        tenure.agg(
            *cols(
                "count(*) AS n",
                f"{rnd('avg(days)')} AS avg_tenure_days",
                *[f"{share} AS {name}" for share, name in within],
            )
        ),
        exact_median(tenure, "days", "every").agg(
            F.expr(f"{rnd('max(median)')} AS median_tenure_days")
        ),
    )
    return row.select(
        "n", "avg_tenure_days", "median_tenure_days", *[name for _, name in within]
    )


def retention_churn_month_distribution(roles: Roles, params: Params) -> DataFrame:
    """Churn event rows of churned accounts per month."""
    events = roles.churn_events.groupBy("account_id", F.expr(f"{month_of('churn_date')} AS month"))
    churned = roles.accounts.filter("churn_flag").select("account_id")
    return (
        events.agg(F.expr("count(*) AS n"))
        .join(churned, "account_id")
        .groupBy("month")
        .agg(F.expr("sum(n) AS acct_churns"))
        .orderBy("month")
    )


def retention_reactivations(roles: Roles, params: Params) -> DataFrame:
    return roles.churn_events.agg(
        *cols(
            "count(*) AS churn_events",
            "count_if(is_reactivation) AS reactivations",
            f"{pct('count_if(is_reactivation)', 'count(*)')} AS reactivation_pct",
        )
    )
