"""What the extracts are made of: computed from the roles one by one, or reduced once for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import (
    ERA,
    cols,
    day,
    exact_avg,
    exact_sum,
    has_bit,
    month_bits,
    month_index,
    month_number,
    month_of,
    within,
)
from stayrate.operators.behaviour import MEASURES, feature_adoption
from stayrate.operators.churn import lost_revenue, reason_counts
from stayrate.operators.kpis import (
    ACTIVE_MRR,
    CHURNED_MRR,
    active_per_month,
    monthly_account_churn,
    monthly_active_accounts,
)
from stayrate.operators.retention import ALL_MONTHS, retention_counts
from stayrate.params import Params
from stayrate.plans.aggregates import monthly
from stayrate.plans.files import new_folder, shared_folder
from stayrate.plans.joins import lookup, small_sides_hashed
from stayrate.plans.lifecycle import (
    FIRST_IS_TRIAL,
    account_span,
    feature_column,
    in_lifetime,
    mature,
    owned_usage,
    segment,
    with_feature,
)
from stayrate.roles import Roles

SUMMED = tuple(measure for measure in MEASURES if measure != "is_beta_feature")

# Bits of a cell's ``flags``; the months after signup follow.
FLAGS = ("early", "adopted", "mature", "account_churned")


class Facts:
    """Inputs of the extracts, each computed from the roles when it is asked for."""

    def __init__(self, roles: Roles, params: Params, ordered: bool = True) -> None:
        self.roles, self.params, self.ordered = roles, params, ordered

    def in_order(self, df: DataFrame, *order: str | Column) -> DataFrame:
        """An extract in its order, for readers of rows; not ``ordered`` for those that aggregate."""
        return df.orderBy(*order) if self.ordered else df

    def spans(self) -> DataFrame:
        return account_span(self.roles)

    def usage_per_account(self) -> DataFrame:
        """Lifetime totals and early feature breadth in one pass over usage.

        Rows are first summed per account and feature, so both distinct counts become plain counts.
        The early window has no churn bound.
        """
        roles, params = self.roles, self.params
        usage = owned_usage(roles, feature_column(roles), *SUMMED, churn=True).selectExpr(
            "*",
            f"{in_lifetime(params.window_end)} AS lived",
            f"{within('days', params.early_window)} AS early",
        )
        usage = with_feature(usage.filter("lived OR early"), roles)
        per_feature = usage.groupBy("account_id", "feature_name").agg(
            *cols(
                "count_if(lived) AS events",
                "max(early) AS early",
                *[f"sum(CASE WHEN lived THEN {m} ELSE 0 END) AS {m}" for m in SUMMED],
            )
        )
        return per_account_totals(per_feature)

    def subscriptions_per_account(self) -> DataFrame:
        return self.roles.subscriptions.groupBy("account_id").agg(
            *cols(
                FIRST_IS_TRIAL,
                f"{exact_sum(ACTIVE_MRR)} AS mrr_active",
                "max(upgrade_flag) AS upgraded",
            )
        )

    def tickets_per_account(self) -> DataFrame:
        return self.roles.tickets.groupBy("account_id").agg(
            *cols(
                "count(*) AS tickets",
                "max(escalation_flag) AS escalated",
                f"{exact_avg('satisfaction_score')} AS csat",
            )
        )

    def monthly_active(self, bounded: bool = True) -> DataFrame:
        return monthly_active_accounts(
            self.roles, self.params, bounded, *self.params.whole_months
        )

    def monthly_mrr(self) -> DataFrame:
        since, until = (day(d) for d in self.params.whole_months)
        return monthly(
            self.roles.subscriptions.filter(f"start_date BETWEEN {since} AND {until}"),
            "start_date",
            "count(*) AS new_subs",
            f"{exact_sum('mrr_amount')} AS new_mrr",
            f"{exact_sum(CHURNED_MRR)} AS churned_mrr",
        )

    def monthly_churn(self, by: str = "event") -> DataFrame:
        return monthly_account_churn(self.roles, self.params, by)

    def retention(self, by: str, bounded: bool = True) -> DataFrame:
        return retention_counts(self.roles, self.params, by, bounded=bounded)

    def reasons(self) -> DataFrame:
        return reason_counts(self.roles)

    def features(self) -> DataFrame:
        """Adoption per adopted feature, with errors and rows over all its usage.

        A feature is the key here, so usage whose key the feature table does not hold has no row.
        """
        roles = self.roles
        key = "feature_name" if roles.features is None else "feature_key"
        per_key = roles.feature_usage.groupBy(key).agg(
            *cols("sum(error_count) AS errors", "count(*) AS events")
        )
        if roles.features is not None:  # reduced to one row per key, so a plain join is enough
            per_key = per_key.join(roles.features, "feature_key")
        volume = per_key.groupBy("feature_name").agg(
            *cols("sum(errors) AS errors", "sum(events) AS events")
        )
        return feature_adoption(roles, self.params).join(volume, "feature_name", "left")

    def lost_revenue(self) -> DataFrame:
        return lost_revenue(self.roles)


def per_account_totals(per_feature: DataFrame, *more: str) -> DataFrame:
    return per_feature.groupBy("account_id").agg(
        *cols(
            "count(feature_name) FILTER (WHERE events > 0) AS distinct_features",
            "count(feature_name) FILTER (WHERE early) AS early_features",
            *[f"sum({m}) AS {m}" for m in ("events", *SUMMED)],
            *more,
        )
    )


def flag(name: str) -> str:
    return has_bit("flags", FLAGS.index(name))


class SharedFacts(Facts):
    """The same inputs from four tables, written once below ``folder``, that all extracts read.

    ``spans``   accounts with the date of their last churn, and their churn events counted by reason
                and month
    ``owners``  subscriptions with signup and churn of their account
    ``cells``   a row per account and feature: totals of all usage and of usage in the lifetime, a bit
                for each active month of the window, and ``flags``: a bit for each of ``FLAGS`` and
                one for each month after signup
    ``usage``   cells reduced to a row per account

    So usage is read, joined and shuffled once, by subscription, and everything after it works on
    rows of the size of the accounts. Usage without a known subscription is kept in ``cells`` for the
    totals per feature, without account. Definitions other than the bounded ones are not in the tables
    and are computed from the roles.
    """

    def __init__(self, roles: Roles, params: Params, folder: str, ordered: bool = True) -> None:
        super().__init__(roles, params, ordered)
        self.spark = roles.accounts.sparkSession
        self.folder = folder
        first, last = params.month_numbers
        self.eras = range(first // ERA, last // ERA + 1)
        self._spans = self._stored("spans", self._dated_accounts())
        owners = self._stored("owners", self._owners())
        self.roles = roles.but(subscriptions=owners)
        self._cells = self._stored("cells", self._reduced_usage(owners))
        self._usage = self._stored("usage", self._usage_of_accounts())

    def _stored(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        with small_sides_hashed(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _dated_accounts(self) -> DataFrame:
        """Events are counted first, so an account's list is as long as its reasons and months."""
        accounts = self.roles.accounts
        counted = self.roles.churn_events.groupBy(
            "account_id", "reason_code", F.expr(f"{month_of('churn_date')} AS month")
        ).agg(*cols("count(*) AS n", "max(churn_date) AS last"))
        listed = counted.groupBy("account_id").agg(
            *cols(
                "max(last) AS last_event",
                "collect_list(struct(reason_code, month, n)) AS churn_events",
            )
        )
        return accounts.join(listed, "account_id", "left").selectExpr(
            *accounts.columns,
            "CASE WHEN churn_flag THEN last_event END AS churn_date",
            "churn_events",
        )

    def _owners(self) -> DataFrame:
        dates = self._spans.selectExpr(
            "account_id", "signup_date", "churn_date", "churn_flag AS account_churned"
        )
        hot = self.roles.hot("subscriptions", "account_id")
        return lookup(self.roles.subscriptions, dates, "account_id", hot, "left")

    def _reduced_usage(self, owners: DataFrame) -> DataFrame:
        roles, params = self.roles, self.params
        owner = owners.filter("signup_date IS NOT NULL").selectExpr(
            "subscription_id", "account_id", "signup_date", "churn_date", "account_churned"
        )
        hot = roles.hot("feature_usage", "subscription_id")
        feature = "feature_name" if roles.features is None else "feature_key"
        usage = roles.feature_usage.select("subscription_id", "usage_date", feature, *SUMMED)
        usage = (
            lookup(usage, owner, "subscription_id", hot, "left")
            .withColumn("days", F.datediff("usage_date", "signup_date"))
            .selectExpr(
                "*",
                f"coalesce({in_lifetime(params.window_end)}, false) AS lived",
                f"{month_index('signup_date', 'usage_date')} AS mi",
            )
        )
        within_year = f"lived AND mi BETWEEN 0 AND {len(ALL_MONTHS) - 1}"
        tests = {
            "early": within("days", params.early_window),
            "adopted": within("days", params.adoption_window),
            "mature": mature(params),
            "account_churned": "account_churned",
        }
        places = [f"CASE WHEN {tests[name]} THEN {1 << i}L ELSE 0L END" for i, name in enumerate(FLAGS)]
        places.append(f"CASE WHEN {within_year} THEN shiftleft(1L, CAST(mi AS INT) + {len(FLAGS)}) ELSE 0L END")
        # Dates go before the features are looked up, which may be one more shuffle of usage.
        usage = usage.selectExpr(
            "account_id",
            feature,
            *SUMMED,
            "lived",
            f"CASE WHEN lived THEN {month_number('usage_date')} END AS m",
            f"{' | '.join(places)} AS flags",
        )
        sums = {m: f"CASE WHEN lived THEN {m} ELSE 0 END" for m in SUMMED} | {
            "events": "CAST(lived AS BIGINT)",
            "all_events": "1L",
            "all_errors": "error_count",
        }
        bits = {f"era{e}": f"CASE WHEN m div {ERA} = {e} THEN m % {ERA} END" for e in self.eras}
        return with_feature(usage, roles).groupBy("account_id", "feature_name").agg(
            *cols(
                *[f"sum({x}) AS {name}" for name, x in sums.items()],
                "bit_or(flags) AS flags",
                *[f"{month_bits(x)} AS {name}" for name, x in bits.items()],
            )
        )

    def _usage_of_accounts(self) -> DataFrame:
        cells = self._cells.filter("account_id IS NOT NULL")
        return per_account_totals(
            cells.withColumn("early", F.expr(flag("early"))),
            f"shiftright(bit_or(flags), {len(FLAGS)}) AS since_signup",
            *[f"bit_or(era{e}) AS era{e}" for e in self.eras],
        )

    def spans(self) -> DataFrame:
        return self._spans

    def usage_per_account(self) -> DataFrame:
        return self._usage.drop("since_signup", *[f"era{e}" for e in self.eras])

    def monthly_active(self, bounded: bool = True) -> DataFrame:
        if not bounded:
            return super().monthly_active(bounded)
        rows = ", ".join(f"struct({e}L AS era, era{e} AS seen)" for e in self.eras)
        return active_per_month(self._usage.selectExpr(f"inline(array({rows}))").filter("seen <> 0"))

    def monthly_churn(self, by: str = "event") -> DataFrame:
        if by != "event":
            return monthly(
                self._spans.filter("churn_date IS NOT NULL"), "churn_date", "count(*) AS accounts_churned"
            )
        months = self._spans.filter("churn_flag").selectExpr(
            "explode(array_distinct(churn_events.month)) AS month"
        )
        return months.groupBy("month").agg(F.expr("count(*) AS accounts_churned"))

    def retention(self, by: str, bounded: bool = True) -> DataFrame:
        if not bounded:
            return super().retention(by, bounded)
        seen = self._usage.selectExpr("account_id", "since_signup AS seen")
        cohort = self._spans.filter(f"signup_date < {day(self.params.cohort_cut)}").selectExpr(
            "account_id", f"{segment(by, self.params)} AS {by}"
        )
        counts = [f"count_if({has_bit('seen', k)}) AS a{k}" for k in ALL_MONTHS]
        return (
            cohort.join(seen, "account_id", "left")
            .groupBy(by)
            .agg(*cols("count(*) AS n", *counts))
        )

    def reasons(self) -> DataFrame:
        counted = self._spans.selectExpr("plan_tier", "inline(churn_events)")
        return counted.groupBy("plan_tier", "reason_code").agg(F.expr("sum(n) AS events"))

    def features(self) -> DataFrame:
        base = (
            self._spans.filter(mature(self.params))
            .agg(F.expr("struct(count(*) AS n, count_if(churn_flag) AS lost)"))
            .scalar()
        )
        return (
            self._cells.filter("feature_name IS NOT NULL")
            .groupBy("feature_name")
            .agg(
                *cols(
                    f"count_if({flag('adopted')}) AS users",
                    f"count_if({flag('adopted')} AND {flag('mature')}) AS adopters",
                    f"count_if({' AND '.join(map(flag, FLAGS[1:]))}) AS adopters_lost",
                    "sum(all_errors) AS errors",
                    "sum(all_events) AS events",
                )
            )
            .filter("users > 0")
            .withColumn("base", base)
            .selectExpr(
                "feature_name",
                "adopters",
                "adopters_lost",
                "base.n - adopters AS others",
                "base.lost - adopters_lost AS others_lost",
                "errors",
                "events",
            )
        )


def facts_of(roles: Roles, params: Params, ordered: bool = True) -> Facts:
    """Facts for many extracts: shared, unless a cluster's session has no shared folder."""
    spark = roles.accounts.sparkSession
    if shared_folder(spark) is None:
        return Facts(roles, params, ordered)
    return SharedFacts(roles, params, new_folder(spark, "facts"), ordered)
