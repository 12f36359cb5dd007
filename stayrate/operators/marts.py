"""Flat reporting extracts, one per grain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.functions.columns import banded, bucketize, cols, day, month_of, ratio, rnd
from stayrate.operators.behaviour import feature_adoption
from stayrate.operators.churn import reason_counts
from stayrate.operators.facts import Facts
from stayrate.operators.retention import ALL_MONTHS, long_cells
from stayrate.params import Params
from stayrate.roles import Roles

# Extract columns and the types their readers declare.
MART_SCHEMAS = {
    "account_metrics": (
        "`Account Id` string, Industry string, Country string, `Signup Date` string, "
        "`Signup Month` string, `Referral Source` string, Plan string, Seats bigint, "
        "`Seat Band` string, `First Sub Type` string, Churned string, `Churn Rate` double, "
        "`Churn Date` string, `Tenure Days` bigint, `Ever Upgraded` bigint, Upgraded bigint, "
        "Events bigint, `Distinct Features` bigint, `Usage Count` bigint, `Hours Used` double, "
        "Errors bigint, `Features First 30d` bigint, `Activation Band` string, Tickets bigint, "
        "Escalated bigint, Csat double, `Mrr Active` double, `Account Count` bigint, Scope string"
    ),
    "monthly_summary": (
        "Month string, `Active Accounts` bigint, `New Subs` bigint, `New Mrr` double, "
        "`Churned Mrr` double, `Account Churns` bigint"
    ),
    "monthly_mrr_long": "Month string, Kind string, Mrr double",
    "cohort_retention": (
        "Cohort string, `Months Since Signup` bigint, `Cohort Size` bigint, "
        "`Active Accounts` bigint, `Pct Active` double"
    ),
    "referral_curves": (
        "`Referral Source` string, `Months Since Signup` bigint, Accounts bigint, "
        "`Pct Active` double"
    ),
    "churn_reasons": "Reason string, Plan string, Events bigint",
    "feature_metrics": (
        "Feature string, Adopters bigint, `Adopter Churn` double, `Nonadopter Churn` double, "
        "Errors bigint, Events bigint, Delta double"
    ),
    "plan_impact": "Plan string, `Churned Subs` bigint, `Mrr Lost` double, `Arr Lost` double",
}


def _shape(name: str, df: DataFrame, *texts: str) -> DataFrame:
    """Give the expressions, in order, the names and types of the extract."""
    schema = T.StructType.fromDDL(MART_SCHEMAS[name])
    return df.selectExpr(
        *[
            f"CAST({text} AS {field.dataType.simpleString()}) AS `{field.name}`"
            for text, field in zip(texts, schema.fields, strict=True)
        ]
    )


def mart_account_metrics(
    roles: Roles, params: Params, facts: Facts | None = None
) -> DataFrame:
    """One row per account; every input is reduced to one row per account before the joins."""
    facts = facts or Facts(roles, params)
    account = (
        facts.spans()
        .join(facts.usage_per_account(), "account_id", "left")
        .join(facts.tickets_per_account(), "account_id", "left")
        .join(facts.subscriptions_per_account(), "account_id", "left")
    )
    upgraded = "coalesce(CAST(upgraded AS INT), 0)"
    early = "coalesce(early_features, 0)"
    return _shape(
        "account_metrics",
        account,
        "account_id",
        "industry",
        "country",
        "date_format(signup_date, 'yyyy-MM-dd')",
        "date_format(signup_date, 'yyyy-MM')",
        "referral_source",
        "plan_tier",
        "seats",
        bucketize("seats", params.seat_edges, banded(params.seat_labels)),
        "CASE WHEN first_is_trial THEN 'trial' ELSE 'paid' END",
        "CASE WHEN churn_flag THEN 'Yes' ELSE 'No' END",
        "churn_flag",
        "coalesce(date_format(churn_date, 'yyyy-MM-dd'), '')",
        f"datediff(coalesce(churn_date, {day(params.window_end)}), signup_date)",
        upgraded,
        upgraded,
        "coalesce(events, 0)",
        "coalesce(distinct_features, 0)",
        "coalesce(usage_count, 0)",
        rnd("coalesce(usage_duration_secs, 0) / 3600D", 1),
        "coalesce(error_count, 0)",
        early,
        bucketize(early, params.breadth_edges, banded(params.breadth_labels)),
        "coalesce(tickets, 0)",
        "coalesce(CAST(escalated AS INT), 0)",
        rnd("csat", 2),
        "coalesce(mrr_active, 0)",
        "1",
        "'All accounts'",
    )


def month_spine(roles: Roles, params: Params) -> DataFrame:
    """The first day of each month of the window."""
    first = day(params.window_start.replace(day=1))
    months = roles.accounts.sparkSession.range(params.months)
    return months.selectExpr(f"add_months({first}, CAST(id AS INT)) AS month")


def mart_monthly_summary(
    roles: Roles,
    params: Params,
    bounded: bool = True,
    by: str = "event",
    facts: Facts | None = None,
) -> DataFrame:
    """Monthly facts stacked on the spine and reduced to one row per month of the window."""
    facts = facts or Facts(roles, params)
    first, last = (day(d.replace(day=1)) for d in (params.window_start, params.window_end))
    parts = (facts.monthly_active(bounded), facts.monthly_mrr(), facts.monthly_churn(by))
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [part.filter(f"month BETWEEN {first} AND {last}") for part in parts],
        month_spine(roles, params),
    )
    measures = ("active_accounts", "new_subs", "new_mrr", "churned_mrr", "accounts_churned")
    months = stacked.groupBy("month").agg(
        *cols(*[f"coalesce(max({m}), 0) AS {m}" for m in measures])
    )
    extract = _shape(
        "monthly_summary",
        months,
        "date_format(month, 'yyyy-MM')",
        "active_accounts",
        "new_subs",
        rnd("new_mrr", 2),
        rnd("churned_mrr", 2),
        "accounts_churned",
    )
    return facts.in_order(extract, "Month")


def mart_monthly_mrr_long(
    roles: Roles, params: Params, facts: Facts | None = None
) -> DataFrame:
    """New and churned MRR as two series; only subscriptions are read."""
    facts = facts or Facts(roles, params)
    wide = (
        month_spine(roles, params)
        .join(facts.monthly_mrr(), "month", "left")
        .selectExpr(
            "date_format(month, 'yyyy-MM') AS Month",
            f"{rnd('coalesce(new_mrr, 0)', 2)} AS `New MRR`",
            f"{rnd('coalesce(churned_mrr, 0)', 2)} AS `Churned MRR`",
        )
    )
    long = wide.unpivot(["Month"], ["New MRR", "Churned MRR"], "Kind", "Mrr")
    return facts.in_order(long, F.desc("Kind"), "Month")


def mart_cohort_retention(
    roles: Roles, params: Params, bounded: bool = True, facts: Facts | None = None
) -> DataFrame:
    facts = facts or Facts(roles, params)
    extract = _shape(
        "cohort_retention",
        long_cells(facts.retention("cohort_month", bounded), "cohort_month"),
        "date_format(cohort_month, 'yyyy-MM')",
        "month_index",
        "n",
        "active",
        rnd("pct_active", 6),
    )
    return facts.in_order(extract, "Cohort", "Months Since Signup")


def mart_referral_curves(
    roles: Roles, params: Params, bounded: bool = True, facts: Facts | None = None
) -> DataFrame:
    facts = facts or Facts(roles, params)
    extract = _shape(
        "referral_curves",
        long_cells(facts.retention("referral_source", bounded), "referral_source"),
        "referral_source",
        "month_index",
        "n",
        rnd("pct_active", 6),
    )
    return facts.in_order(extract, "Referral Source", "Months Since Signup")


def mart_churn_reasons(roles: Roles, params: Params, facts: Facts | None = None) -> DataFrame:
    facts = facts or Facts(roles, params)
    extract = _shape(
        "churn_reasons", facts.reasons(), "reason_code", "plan_tier", "events"
    )
    return facts.in_order(extract, "Plan", "Reason")


def mart_feature_metrics(roles: Roles, params: Params, facts: Facts | None = None) -> DataFrame:
    """Adoption against churn per adopted feature, with errors and rows over all its usage."""
    facts = facts or Facts(roles, params)
    lost, kept = ratio("adopters_lost", "adopters"), ratio("others_lost", "others")
    extract = _shape(
        "feature_metrics",
        facts.features(),
        "feature_name",
        "adopters",
        rnd(lost, 6),
        rnd(kept, 6),
        "coalesce(errors, 0)",
        "coalesce(events, 0)",
        rnd(f"({lost} - {kept}) * 100D", 4),
    )
    return facts.in_order(extract, "Feature")


def mart_plan_impact(roles: Roles, params: Params, facts: Facts | None = None) -> DataFrame:
    facts = facts or Facts(roles, params)
    extract = _shape(
        "plan_impact",
        facts.lost_revenue(),
        "plan_tier",
        "churned_subs",
        rnd("mrr", 2),
        rnd("arr", 2),
    )
    return facts.in_order(extract, F.desc("Arr Lost"), "Plan")


MARTS = {
    "account_metrics": mart_account_metrics,
    "monthly_summary": mart_monthly_summary,
    "monthly_mrr_long": mart_monthly_mrr_long,
    "cohort_retention": mart_cohort_retention,
    "referral_curves": mart_referral_curves,
    "churn_reasons": mart_churn_reasons,
    "feature_metrics": mart_feature_metrics,
    "plan_impact": mart_plan_impact,
}


def mart_row_counts(roles: Roles, params: Params) -> DataFrame:
    """Rows each extract would have, from the keys of the extracts alone."""
    spark = roles.accounts.sparkSession
    cohort = roles.accounts.filter(f"signup_date < {day(params.cohort_cut)}")

    def keys(df: DataFrame, *columns: str, times: int = 1) -> DataFrame:
        return df.selectExpr(*columns).distinct().agg(F.expr(f"count(*) * {times} AS rows"))

    months = len(ALL_MONTHS)
    reasons = reason_counts(roles)
    counts = {
        "account_metrics": roles.accounts.agg(F.expr("count(*) AS rows")),
        "monthly_summary": spark.range(1).selectExpr(f"{params.months}L AS rows"),
        "monthly_mrr_long": spark.range(1).selectExpr(f"{2 * params.months}L AS rows"),
        "cohort_retention": keys(cohort, f"{month_of('signup_date')} AS month", times=months),
        "referral_curves": keys(cohort, "referral_source", times=months),
        "churn_reasons": reasons.agg(F.expr("count(*) AS rows")),
        "feature_metrics": feature_adoption(roles, params).agg(F.expr("count(*) AS rows")),
        "plan_impact": keys(roles.subscriptions.filter("churn_flag"), "plan_tier"),
    }
    return reduce(
        DataFrame.unionByName,
        [df.selectExpr(f"'{name}' AS extract", "rows") for name, df in counts.items()],
    )
