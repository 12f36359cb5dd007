"""Every operator by name, with the variants that need their own parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame

from stayrate.operators import (
    behaviour,
    churn,
    dashboard,
    growth,
    kpis,
    marts,
    quality,
    retention,
    significance,
)
from stayrate.params import Params
from stayrate.roles import Roles
from stayrate.sinks import extracts
from stayrate.sinks import roles as csv_roles

Operator = Callable[[Roles, Params], DataFrame]

_PREFIXES = {
    quality: "dq_",
    kpis: "kpi_",
    growth: "growth_",
    retention: "retention_",
    churn: "churn_",
    behaviour: "behaviour_",
    significance: "stats_",
    marts: "mart_",
    dashboard: "mart_dashboard_",
    csv_roles: "source_csv_",
}
# Building blocks that share a prefix with the operators made of them.
_NOT_OPERATORS = {
    "churn_by",
    "churn_reason_mix_by_plan",
    "mart_view",
    "retention_counts",
    "retention_long",
    "retention_wide",
    "stats_chi_square_pairwise",
}


def _with(operator: Operator, **changes) -> Operator:
    return lambda roles, params: operator(roles, replace(params, **changes))


def variants() -> dict[str, Operator]:
    """Operators with another definition or window than their default."""
    return {
        # usage after churn or before signup counted as the reference's SQL does
        "kpi_monthly_active_accounts_unbounded": partial(
            kpis.kpi_monthly_active_accounts, bounded=False
        ),
        "retention_cohort_matrix_unbounded": partial(
            retention.retention_cohort_matrix, bounded=False
        ),
        "retention_by_source_unbounded": partial(retention.retention_by_source, bounded=False),
        "retention_by_industry_unbounded": partial(retention.retention_by_industry, bounded=False),
        "retention_by_seat_bucket_unbounded": partial(
            retention.retention_by_seat_bucket, bounded=False
        ),
        "mart_monthly_summary_unbounded": partial(marts.mart_monthly_summary, bounded=False),
        "mart_cohort_retention_unbounded": partial(marts.mart_cohort_retention, bounded=False),
        "mart_referral_curves_unbounded": partial(marts.mart_referral_curves, bounded=False),
        "mart_feature_metrics_unbounded": _with(
            marts.mart_feature_metrics, adoption_window=(None, 60)
        ),
        # other definitions the reference's notebook uses
        "kpi_monthly_account_churn_last": partial(kpis.kpi_monthly_account_churn, by="last"),
        "retention_curve_long_cohorts": partial(
            retention.retention_curve_long, by="cohort_month"
        ),
        "growth_activation_buckets_bounded": partial(
            growth.growth_activation_buckets, bounded=True
        ),
        "behaviour_usage_by_outcome_open_end": partial(
            behaviour.behaviour_usage_by_outcome, open_end=True
        ),
        "behaviour_feature_adoption_bounded": partial(
            behaviour.behaviour_feature_adoption, bounded=True
        ),
        "behaviour_support_by_outcome_ticketed": partial(
            behaviour.behaviour_support_by_outcome, only_ticketed=True
        ),
        # a year instead of a month, for data with slow early use
        "growth_activation_sweep_365d": _with(
            growth.growth_activation_sweep, early_window=(0, 365)
        ),
        "growth_activation_buckets_365d": _with(
            growth.growth_activation_buckets, early_window=(0, 365)
        ),
    }


def operators(reasons: tuple[str, ...], pair: tuple[str, str]) -> dict[str, Operator]:
    """``reasons`` are the columns of the reason matrix, ``pair`` the two sources to compare."""
    found: dict[str, Operator] = {}
    for module, prefix in _PREFIXES.items():
        for name, value in vars(module).items():
            if name.startswith(prefix) and callable(value) and name not in _NOT_OPERATORS:
                found[name] = value
    found["churn_reason_mix_by_plan"] = partial(churn.churn_reason_mix_by_plan, reasons=reasons)
    found["stats_chi_square_pairwise"] = partial(
        significance.stats_chi_square_pairwise, a=pair[0], b=pair[1]
    )
    found["mart_dashboard_from_extracts"] = extracts.dashboard_through_extracts
    return found | variants()
