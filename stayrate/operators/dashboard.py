"""The worksheets of the four dashboards as one long table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import exact_avg, exact_sum, rnd, text
from stayrate.operators.facts import facts_of
from stayrate.operators.marts import MARTS
from stayrate.params import Params
from stayrate.roles import Roles

# Fixed values. Per extract: dashboard, worksheet, dimensions, aggregate, measure.
WORKSHEETS: dict[str, list[tuple[str, str, tuple[str, ...], str, str]]] = {
    "account_metrics": [
        ("Product Health", "KPI Accounts", ("Scope",), "sum", "Account Count"),
        ("Product Health", "KPI Churn Rate", ("Scope",), "avg", "Churn Rate"),
        ("Product Health", "KPI Active MRR", ("Scope",), "sum", "Mrr Active"),
        ("Product Health", "KPI Upgrade Rate", ("Scope",), "avg", "Upgraded"),
        (
            "Growth & Activation",
            "Signups by Source",
            ("Signup Month", "Referral Source"),
            "sum",
            "Account Count",
        ),
        ("Growth & Activation", "Upgrade Rate by Plan", ("Plan",), "avg", "Upgraded"),
        ("Growth & Activation", "Activation vs Churn", ("Activation Band",), "avg", "Churn Rate"),
        ("Growth & Activation", "Breadth by Outcome", ("Churned",), "avg", "Features First 30d"),
        ("Retention & Churn", "Churn by Industry", ("Industry",), "avg", "Churn Rate"),
        ("Retention & Churn", "Churn by Source", ("Referral Source",), "avg", "Churn Rate"),
        ("Retention & Churn", "Churn by Seat Band", ("Seat Band",), "avg", "Churn Rate"),
        ("Product Diagnosis", "Usage vs Outcome", ("Churned",), "avg", "Events"),
        ("Product Diagnosis", "Support vs Outcome", ("Churned",), "avg", "Tickets"),
        ("Product Diagnosis", "Escalation vs Outcome", ("Churned",), "avg", "Escalated"),
    ],
    "monthly_summary": [
        ("Product Health", "Monthly Active Accounts", ("Month",), "sum", "Active Accounts"),
        ("Product Health", "Churn Trend", ("Month",), "sum", "Account Churns"),
    ],
    "monthly_mrr_long": [
        ("Product Health", "Revenue Movement", ("Month", "Kind"), "sum", "Mrr"),
    ],
    "cohort_retention": [
        (
            "Retention & Churn",
            "Cohort Heatmap",
            ("Cohort", "Months Since Signup"),
            "avg",
            "Pct Active",
        ),
    ],
    "referral_curves": [
        (
            "Retention & Churn",
            "Retention Curves",
            ("Months Since Signup", "Referral Source"),
            "avg",
            "Pct Active",
        ),
    ],
    "churn_reasons": [
        ("Retention & Churn", "Churn Reasons", ("Reason",), "sum", "Events"),
        ("Retention & Churn", "Reasons by Plan", ("Plan", "Reason"), "sum", "Events"),
    ],
    "feature_metrics": [
        ("Product Diagnosis", "Feature Adoption vs Churn", ("Feature",), "avg", "Adopters"),
        ("Product Diagnosis", "Feature Adoption vs Churn", ("Feature",), "avg", "Adopter Churn"),
        ("Product Diagnosis", "Feature Adoption vs Churn", ("Feature",), "avg", "Delta"),
    ],
    "plan_impact": [
        ("Product Diagnosis", "ARR at Risk by Plan", ("Plan",), "sum", "Arr Lost"),
    ],
}


def mart_view(df: DataFrame, sheets: Sequence[tuple]) -> DataFrame:
    """All worksheets of one extract in one aggregation over it.

    Every row becomes one row per worksheet and is reduced again before the shuffle, so the extract
    is computed once, however many worksheets read it.
    """

    def dim(dims: tuple[str, ...], i: int) -> str:
        return f"CAST({f'`{dims[i]}`' if i < len(dims) else 'NULL'} AS STRING) AS dim{i + 1}"

    def named(names: list[str]) -> str:
        cases = " ".join(f"WHEN {i} THEN {text(name)}" for i, name in enumerate(names[:-1]))
        return f"CASE sheet {cases} ELSE {text(names[-1])} END" if cases else text(names[-1])

    # The number of a worksheet is its key, its names come back after the reduction.
    rows = ", ".join(
        f"struct({i} AS sheet, {dim(dims, 0)}, {dim(dims, 1)}, CAST(`{measure}` AS DOUBLE) AS v)"
        for i, (_, _, dims, _, measure) in enumerate(sheets)
    )
    averaged = [i for i, sheet in enumerate(sheets) if sheet[3] == "avg"]
    average = f"sheet IN ({', '.join(map(str, averaged))})" if averaged else "false"
    value = rnd(f"CASE WHEN {average} THEN {exact_avg('v')} ELSE {exact_sum('v')} END", 4)
    names = {
        "dashboard": [sheet[0] for sheet in sheets],
        "worksheet": [sheet[1] for sheet in sheets],
        "measure": [f"{agg} {measure}" for _, _, _, agg, measure in sheets],
    }
    return (
        df.selectExpr(f"inline(array({rows}))")
        .groupBy("sheet", "dim1", "dim2")
        .agg(F.expr(f"{value} AS value"))
        .selectExpr(*[f"{named(n)} AS {column}" for column, n in names.items()], "dim1", "dim2", "value")
    )


def dashboard_from(mart: Callable[[str], DataFrame]) -> DataFrame:
    """Long table over extracts given by name, computed or read back."""
    return reduce(
        DataFrame.unionByName, [mart_view(mart(name), rows) for name, rows in WORKSHEETS.items()]
    )


def mart_dashboard_long(roles: Roles, params: Params) -> DataFrame:
    """All worksheets, from extracts that share one reduction of usage.

    Where the session has a shared folder the reduction is written there before the result is read.
    """
    facts = facts_of(roles, params, ordered=False)
    return dashboard_from(lambda name: MARTS[name](roles, params, facts=facts))
