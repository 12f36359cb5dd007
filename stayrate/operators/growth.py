"""Acquisition, trials and early activation."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import bucketize, cols, day, pct, rnd, within
from stayrate.params import Params
from stayrate.plans.aggregates import exact_median, rate_by
from stayrate.plans.joins import side_by_side
from stayrate.plans.lifecycle import (
    FIRST_IS_TRIAL,
    feature_column,
    in_lifetime,
    mature,
    owned_usage,
    with_feature,
)
from stayrate.roles import Roles


def growth_signups_by_source(roles: Roles, params: Params) -> DataFrame:
    return (
        roles.accounts.groupBy(F.expr("trunc(signup_date, 'year') AS yr"), "referral_source")
        .agg(F.expr("count(*) AS signups"))
        .orderBy("yr", F.desc("signups"), "referral_source")
    )


def growth_trial_structure(roles: Roles, params: Params) -> DataFrame:
    """Accounts by the kind of their first subscription; without one they count in total only."""
    first = roles.subscriptions.groupBy("account_id").agg(F.expr(FIRST_IS_TRIAL))
    return (
        roles.accounts.select("account_id")
        .join(first, "account_id", "left")
        .agg(
            *cols(
                "count_if(first_is_trial) AS trial_first_accounts",
                "count_if(NOT first_is_trial) AS paid_first_accounts",
                "count(*) AS total",
            )
        )
    )


def growth_trial_conversion(roles: Roles, params: Params) -> DataFrame:
    """Trial to paid, strictly: the first day holds trials only and a paid start comes later."""
    starts = roles.subscriptions.groupBy("account_id").agg(
        *cols(
            "min(start_date) AS first_start",
            "min(start_date) FILTER (WHERE NOT is_trial) AS first_paid",
        )
    )
    return (
        starts.filter("first_paid IS NULL OR first_paid > first_start")
        .join(roles.accounts.select("account_id"), "account_id", "left_semi")
        .agg(
            *cols(
                "count(*) AS trial_first_accts",
                "count(first_paid) AS converted",
                f"{pct('count(first_paid)', 'count(*)')} AS conversion_pct",
                f"{rnd('avg(datediff(first_paid, first_start))', 1)} AS avg_days_to_convert",
            )
        )
    )


def growth_upgrades_by_plan(roles: Roles, params: Params) -> DataFrame:
    per_account = roles.subscriptions.groupBy("plan_tier", "account_id").agg(
        F.expr("max(upgrade_flag) AS up")
    )
    counts = per_account.groupBy("plan_tier").agg(
        *cols("count(account_id) AS accts", "count(account_id) FILTER (WHERE up) AS upgraded")
    )
    return counts.withColumn("upgrade_pct", F.expr(pct("upgraded", "accts"))).orderBy("plan_tier")


def early_usage(roles: Roles, params: Params, *measures: str, bounded: bool = False) -> DataFrame:
    """Usage of mature accounts inside the early window; ``bounded`` drops usage after churn.

    The latest day the window can reach is a filter of its own, applied where usage is scanned.
    """
    end = params.maturity_cut + timedelta(days=params.early_window[1])
    usage = owned_usage(roles, *measures, churn=bounded, until=end)
    usage = usage.filter(f"{mature(params)} AND {within('days', params.early_window)}")
    return usage.filter(in_lifetime(None)) if bounded else usage


def _mature_accounts(roles: Roles, params: Params, counts: DataFrame, name: str) -> DataFrame:
    """Mature accounts with a count of theirs, 0 where they have none."""
    base = roles.accounts.filter(mature(params)).select("account_id", "churn_flag")
    return base.join(counts, "account_id", "left").selectExpr(
        "churn_flag", f"coalesce({name}, 0) AS {name}"
    )


def early_breadth(roles: Roles, params: Params, bounded: bool = False) -> DataFrame:
    """Mature accounts with the number of distinct features they used early on."""
    seen = with_feature(early_usage(roles, params, feature_column(roles), bounded=bounded), roles)
    breadth = (
        seen.select("account_id", "feature_name")
        .distinct()
        .groupBy("account_id")
        .agg(F.expr("count(feature_name) AS feats_30d"))
    )
    return _mature_accounts(roles, params, breadth, "feats_30d")


def growth_activation_sweep(roles: Roles, params: Params, bounded: bool = False) -> DataFrame:
    base = early_breadth(roles, params, bounded)
    return rate_by(base, ["feats_30d"], "churn_flag").orderBy("feats_30d")


def growth_activation_buckets(roles: Roles, params: Params, bounded: bool = False) -> DataFrame:
    bucket = bucketize("feats_30d", params.breadth_edges, params.breadth_labels)
    base = early_breadth(roles, params, bounded).withColumn("breadth_bucket", F.expr(bucket))
    smallest = "min(feats_30d) AS smallest"
    return (
        rate_by(base, ["breadth_bucket"], "churn_flag", extra=[smallest])
        .orderBy("smallest")
        .select("breadth_bucket", "n", "churn_pct")
    )


def growth_activation_intensity(roles: Roles, params: Params) -> DataFrame:
    """Early usage rows per mature account, churned against kept."""
    events = early_usage(roles, params).groupBy("account_id").agg(F.expr("count(*) AS ev"))
    base = _mature_accounts(roles, params, events, "ev")
    return side_by_side(
        base.agg(
            *cols(
                f"{rnd('avg(ev) FILTER (WHERE churn_flag)', 1)} AS avg_ev_churned",
                f"{rnd('avg(ev) FILTER (WHERE NOT churn_flag)', 1)} AS avg_ev_kept",
            )
        ),
        exact_median(base, "ev", "churn_flag").agg(
            *cols(
                f"{rnd('max(median) FILTER (WHERE churn_flag)', 1)} AS med_ev_churned",
                f"{rnd('max(median) FILTER (WHERE NOT churn_flag)', 1)} AS med_ev_kept",
            )
        ),
    )


def growth_usage_persistence(roles: Roles, params: Params) -> DataFrame:
    """Accounts that used the product in the first window and again in the next."""
    first, later = (within("days", w) for w in params.persistence_windows)
    used = (
        owned_usage(roles)
        .filter(f"{first} OR {later}")
        .groupBy("account_id")
        .agg(*cols(f"max({first}) AS early", f"max({later}) AS later"))
    )
    return used.agg(
        *cols(
            "count_if(early) AS used_first_30d",
            "count_if(early AND later) AS also_used_next_30d",
            f"{pct('count_if(early AND later)', 'count_if(early)')} AS pct_continued",
        )
    )
