"""Whether segments differ in churn by more than chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import cols, exact_sum, ratio, rnd, text
from stayrate.functions.distributions import chi_square_p
from stayrate.params import Params
from stayrate.plans.aggregates import rate_by
from stayrate.plans.lifecycle import segment
from stayrate.roles import Roles

SEGMENTS = ("industry", "referral_source", "seat_bucket", "plan_tier")


def segment_rates(accounts: DataFrame, params: Params, segments: Sequence[str]) -> DataFrame:
    """Accounts and churned accounts per (segment, segment_value); NULL values stay out.

    Every account goes through one aggregation as one row per segment.
    """
    cuts = ", ".join(
        f"struct({text(name)} AS segment, CAST({segment(name, params)} AS STRING) AS segment_value)"
        for name in segments
    )
    rows = accounts.filter("churn_flag IS NOT NULL").selectExpr(
        "churn_flag", f"inline(array({cuts}))"
    )
    return rate_by(
        rows.filter("segment_value IS NOT NULL"), ["segment", "segment_value"], "churn_flag"
    )


def contingency(accounts: DataFrame, params: Params, segments: Sequence[str]) -> DataFrame:
    """Observed and expected accounts per segment value and churn_flag, empty cells included.

    ``dof`` is the freedom of the table of values and outcomes that occur at all.
    """
    counts = segment_rates(accounts, params, segments)
    totals = counts.groupBy("segment").agg(
        *cols("sum(n) AS total", "sum(churned) AS lost", "count(*) AS n_values")
    )
    outcomes = "CAST(lost > 0 AS INT) + CAST(lost < total AS INT)"
    cells = (
        "struct(false AS churn_flag, n - churned AS observed, total - lost AS outcome), "
        "struct(true AS churn_flag, churned AS observed, lost AS outcome)"
    )
    return (
        counts.join(totals, "segment")
        .selectExpr("*", f"inline(array({cells}))")
        .filter("outcome > 0")
        .selectExpr(
            "segment",
            "segment_value",
            "churn_flag",
            "observed",
            "CAST(n AS DOUBLE) * outcome / total AS expected",
            f"CAST((n_values - 1) * ({outcomes} - 1) AS INT) AS dof",
        )
    )


def chi_square(accounts: DataFrame, params: Params, segments: Sequence[str]) -> DataFrame:
    """Pearson's test of independence per segment; Yates' correction applies at one degree."""
    gap = "abs(observed - expected) - CASE WHEN dof = 1 THEN 0.5D ELSE 0D END"
    tests = (
        contingency(accounts, params, segments)
        .groupBy("segment", "dof")
        .agg(F.expr(f"{exact_sum(f'(power(greatest({gap}, 0D), 2) / expected)')} AS chi2"))
        .withColumn("p", F.expr(chi_square_p("chi2", "dof")))
    )
    return tests.selectExpr(
        "segment AS test", f"{rnd('chi2', 4)} AS chi2", "dof", f"{rnd('p', 6)} AS p_value"
    )


def stats_contingency(roles: Roles, params: Params, by: str = "referral_source") -> DataFrame:
    return (
        contingency(roles.accounts, params, [by])
        .selectExpr(
            "segment_value", "churn_flag", "observed", f"{rnd('expected', 4)} AS expected"
        )
        .orderBy("segment_value", "churn_flag")
    )


def stats_chi_square(
    roles: Roles, params: Params, segments: Sequence[str] = ("referral_source", "industry")
) -> DataFrame:
    return chi_square(roles.accounts, params, segments)


def stats_chi_square_pairwise(
    roles: Roles, params: Params, a: str, b: str, by: str = "referral_source"
) -> DataFrame:
    """Two values of a segment against each other."""
    pair = roles.accounts.filter(F.expr(segment(by, params)).isin(a, b))
    return chi_square(pair, params, [by]).withColumn("test", F.lit(f"{a} vs {b}"))


def stats_segment_delta(roles: Roles, params: Params) -> DataFrame:
    """Churn per value of each segment, and its distance to overall churn in points."""
    overall = roles.accounts.agg(F.expr(ratio("count_if(churn_flag)", "count(*)"))).scalar()
    rates = segment_rates(roles.accounts, params, SEGMENTS).withColumn("overall", overall)
    gap = f"100D * ({ratio('churned', 'n')} - overall)"
    return (
        rates.withColumn("delta_pct", F.expr(rnd(gap, 1)))
        .drop("overall")
        .orderBy("segment", F.desc("churn_pct"), "segment_value")
    )
