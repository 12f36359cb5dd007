"""Hand-made accounts, one rule each."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from row_values import rows_of
from pyspark.sql import functions as F

from stayrate.operators import behaviour, churn, growth, kpis, marts, quality, retention
from stayrate.operators import significance as stats
from stayrate.params import Params

SIGNUP = date(2023, 1, 10)


def day(n: int, start: date = SIGNUP) -> date:
    return start + timedelta(days=n)


def one(df) -> dict:
    (row,) = df.collect()
    return row.asDict()


@pytest.fixture(scope="module")
def lifecycle(make_roles):
    """a1 churned on day 100, a2 stayed, a3 churned without an event, a4 has nothing at all."""
    return make_roles(
        accounts=[
            dict(account_id="a1", churn_flag=True, seats=None),
            dict(account_id="a2", seats=5, referral_source="event"),
            dict(account_id="a3", churn_flag=True, seats=51),
            dict(account_id="a4", seats=20),
        ],
        subscriptions=[
            dict(subscription_id="s1", account_id="a1", churn_flag=True, end_date=day(-1)),
            dict(subscription_id="s2", account_id="a2", upgrade_flag=True),
            dict(subscription_id="s3", account_id="a3", downgrade_flag=True, upgrade_flag=True),
            dict(subscription_id="s9", account_id="gone"),
        ],
        feature_usage=[
            dict(subscription_id="s1", usage_date=day(-1), usage_id="dup"),
            dict(subscription_id="s1", usage_date=day(0), usage_id="dup"),
            dict(subscription_id="s1", usage_date=day(100), usage_count=7, is_beta_feature=True),
            dict(subscription_id="s1", usage_date=day(101)),
            dict(subscription_id="s2", usage_date=day(45), feature_name="f2", error_count=2),
            dict(subscription_id="s2", usage_date=date(2025, 1, 1)),
            dict(subscription_id="s3", usage_date=day(10)),
            dict(subscription_id="s3", usage_date=day(40)),
            dict(subscription_id="lost", usage_date=day(1)),
            dict(subscription_id=None, usage_date=day(1)),
        ],
        support_tickets=[
            dict(account_id="a1", submitted_at=datetime(2023, 4, 20, 23), escalation_flag=True),
            dict(account_id="a1", submitted_at=datetime(2023, 4, 21, 1), escalation_flag=True),
            dict(account_id="a2", satisfaction_score=4.0),
            dict(account_id="nobody"),
        ],
        churn_events=[
            dict(account_id="a1", churn_date=day(30), churn_event_id="c1"),
            dict(account_id="a1", churn_date=day(100), churn_event_id="c2", reason_code="bugs"),
            dict(account_id="a2", churn_date=day(50), churn_event_id="c3", is_reactivation=True),
            dict(account_id="a2", churn_date=day(-5), churn_event_id="c4"),
        ],
    )


def test_usage_outside_the_lifetime(lifecycle, params):
    assert rows_of(quality.dq_usage_after_churn(lifecycle, params)) == [(1, 1)]
    assert rows_of(quality.dq_usage_before_signup(lifecycle, params)) == [(1, 1)]


def test_lifetime_includes_both_ends_and_stops_at_the_window(lifecycle, params):
    got = {r["churn_flag"]: r for r in behaviour.behaviour_usage_by_outcome(lifecycle, params).collect()}
    # a1 keeps day 0 and day 100, a3 has no event and keeps both rows; a2 loses 2025
    assert (got[True]["accounts"], got[True]["avg_events"]) == (2, 2.0)
    assert (got[False]["accounts"], got[False]["avg_events"], got[False]["avg_errors"]) == (1, 1.0, 2.0)
    open_end = behaviour.behaviour_usage_by_outcome(lifecycle, params, open_end=True)
    assert {r["churn_flag"]: r["avg_events"] for r in open_end.collect()} == {True: 2.0, False: 2.0}


def test_quality_counts(lifecycle, params):
    orphans = dict(rows_of(quality.dq_fk_orphans(lifecycle, params)))
    assert orphans == {
        "usage -> subscriptions": 2,
        "subscriptions -> accounts": 1,
        "tickets -> accounts": 1,
        "churn_events -> accounts": 0,
    }
    assert rows_of(quality.dq_bad_ranges(lifecycle, params)) == [(1,)]
    assert rows_of(quality.dq_churn_before_signup(lifecycle, params)) == [(1,)]
    assert ("u", 8) in rows_of(quality.dq_duplicate_keys(lifecycle, params))
    assert ("dup", 2) in rows_of(quality.dq_duplicate_keys(lifecycle, params))
    nulls = {(t, c): n for t, c, n in rows_of(quality.dq_null_profile(lifecycle, params))}
    assert nulls["accounts", "seats"] == 1
    assert nulls["support_tickets", "satisfaction_score"] == 3
    assert one(quality.dq_churn_definitions(lifecycle, params)) == {
        "account_churn": 2,
        "subscription_churn": 1,
        "churn_event_rows": 4,
        "reactivations": 1,
    }
    assert one(quality.dq_numeric_distribution(lifecycle, params)) == {
        "min_seats": 5,
        "max_seats": 51,
        "avg_seats": 25.3,
        "median_seats": 20.0,
    }


def test_empty_tables(make_roles, params):
    empty = make_roles()
    assert one(quality.dq_date_extents_cross(empty, params))["min_signup"] is None
    assert rows_of(quality.dq_fk_orphans(empty, params))[0][1] == 0
    assert one(kpis.kpi_topline(empty, params))["account_churn_pct"] is None
    assert one(growth.growth_usage_persistence(empty, params))["pct_continued"] is None
    assert one(retention.retention_tenure_at_churn(empty, params))["median_tenure_days"] is None
    assert rows_of(retention.retention_cohort_matrix(empty, params)) == []
    assert rows_of(stats.stats_chi_square(empty, params)) == []
    assert rows_of(stats.stats_segment_delta(empty, params)) == []
    assert rows_of(behaviour.behaviour_feature_adoption(empty, params)) == []
    assert rows_of(marts.mart_account_metrics(empty, params)) == []
    assert len(rows_of(marts.mart_monthly_summary(empty, params))) == 24


def test_extents_of_a_product_vanish_with_one_empty_side(make_roles, params):
    half = make_roles(accounts=[dict(account_id="a")])
    assert set(one(quality.dq_date_extents_cross(half, params)).values()) == {None}
    assert one(quality.dq_date_extents(half, params))["min_signup"] == SIGNUP


def test_monthly_churn_by_event_and_by_last_event(lifecycle, params):
    by_event = rows_of(kpis.kpi_monthly_account_churn(lifecycle, params))
    assert by_event == [(date(2023, 2, 1), 1), (date(2023, 4, 1), 1)]
    assert rows_of(kpis.kpi_monthly_account_churn(lifecycle, params, by="last")) == [
        (date(2023, 4, 1), 1)
    ]


def test_active_accounts_with_and_without_the_churn_bound(lifecycle, params):
    bounded = dict(rows_of(kpis.kpi_monthly_active_accounts(lifecycle, params)))
    loose = dict(rows_of(kpis.kpi_monthly_active_accounts(lifecycle, params, bounded=False)))
    assert bounded == {date(2023, 1, 1): 2, date(2023, 2, 1): 2, date(2023, 4, 1): 1}
    assert loose == bounded | {date(2025, 1, 1): 1}


def test_expansion_and_upgrades(lifecycle, params):
    assert rows_of(kpis.kpi_expansion_contraction(lifecycle, params)) == [(4, 2, 1, 1)]
    assert rows_of(growth.growth_upgrades_by_plan(lifecycle, params)) == [("Pro", 4, 2, 50.0)]


def test_persistence(lifecycle, params):
    # a1 and a3 used days 0-29, of these only a3 days 30-59
    assert rows_of(growth.growth_usage_persistence(lifecycle, params)) == [(2, 1, 50.0)]


def test_support(lifecycle, params):
    got = {r["churn_flag"]: r for r in behaviour.behaviour_support_by_outcome(lifecycle, params).collect()}
    assert (got[True]["accts"], got[True]["avg_tickets"], got[True]["pct_accts_escalated"]) == (2, 2.0, 50.0)
    assert (got[False]["accts"], got[False]["avg_tickets"], got[False]["avg_csat"]) == (2, 1.0, 4.0)
    only = behaviour.behaviour_support_by_outcome(lifecycle, params, only_ticketed=True)
    assert {r["churn_flag"]: r["accts"] for r in only.collect()} == {True: 1, False: 1}
    # the second ticket falls on the day after the last churn date (20 April)
    assert rows_of(behaviour.behaviour_escalations_before_churn(lifecycle, params)) == [(1, 0, 1)]


def test_prechurn_windows(lifecycle, params):
    assert rows_of(behaviour.behaviour_prechurn_windows(lifecycle, params)) == [(7.0, None, 1.0)]


def test_account_extract(lifecycle, params):
    rows = {r["Account Id"]: r for r in marts.mart_account_metrics(lifecycle, params).collect()}
    assert len(rows) == 4
    a1, a2, a4 = rows["a1"], rows["a2"], rows["a4"]
    assert (a1["Churn Date"], a1["Tenure Days"], a1["Seat Band"]) == ("2023-04-20", 100, None)
    assert (a1["Events"], a1["Distinct Features"], a1["Features First 30d"]) == (2, 1, 1)
    assert (a1["Mrr Active"], a1["Escalated"], a1["Churned"]) == (0.0, 1, "Yes")
    assert (a2["Events"], a2["Features First 30d"], a2["Csat"]) == (1, 0, 4.0)
    assert (a4["Events"], a4["Tickets"], a4["Mrr Active"], a4["Csat"]) == (0, 0, 0.0, None)
    assert (a4["First Sub Type"], a4["Activation Band"], a4["Churn Date"]) == ("paid", "A 0-2", "")


def test_retention_zero_cells_and_month_ends(make_roles, params):
    roles = make_roles(
        accounts=[
            dict(account_id="a", signup_date=date(2023, 1, 31)),
            dict(account_id="b", signup_date=date(2023, 1, 2)),
            dict(account_id="idle", signup_date=date(2023, 3, 5)),
            dict(account_id="late", signup_date=date(2024, 1, 1)),
        ],
        subscriptions=[dict(subscription_id=f"s{a}", account_id=a) for a in ("a", "b", "late")],
        feature_usage=[
            dict(subscription_id="sa", usage_date=date(2023, 2, 1)),
            dict(subscription_id="sa", usage_date=date(2023, 2, 1)),
            dict(subscription_id="sa", usage_date=date(2023, 1, 30)),  # before signup
            dict(subscription_id="sb", usage_date=date(2023, 12, 31)),
            dict(subscription_id="sb", usage_date=date(2024, 1, 1)),  # month 12
            dict(subscription_id="slate", usage_date=date(2024, 1, 1)),
        ],
    )
    matrix = rows_of(retention.retention_cohort_matrix(roles, params))
    zeros = [0.0] * 12
    january = zeros.copy()
    january[1] = january[11] = 50.0
    assert matrix == [(date(2023, 1, 1), 2, *january), (date(2023, 3, 1), 1, *zeros)]
    loose = rows_of(retention.retention_cohort_matrix(roles, params, bounded=False))
    assert loose[0][2] == 50.0
    cells = rows_of(marts.mart_cohort_retention(roles, params))
    assert len(cells) == 24
    assert ("2023-03", 0, 1, 0, 0.0) in cells
    assert ("2023-01", 1, 2, 1, 0.5) in cells


def test_retention_reads_usage_up_to_its_last_month(make_roles, params):
    assert retention.activity_end(date(2024, 1, 1), range(12)) == date(2024, 12, 1)
    assert retention.activity_end(date(2024, 1, 15), (0, 11)) == date(2025, 1, 1)
    assert retention.activity_end(date(2023, 3, 1), (0,)) == date(2023, 3, 1)
    roles = make_roles(
        accounts=[dict(account_id="a", signup_date=date(2023, 12, 31))],
        subscriptions=[dict(subscription_id="s", account_id="a")],
        feature_usage=[
            dict(subscription_id="s", usage_date=date(2024, 11, 30)),
            dict(subscription_id="s", usage_date=date(2024, 12, 1)),
        ],
    )
    (row,) = rows_of(retention.retention_cohort_matrix(roles, params))
    assert row[2:] == (0.0,) * 11 + (100.0,)


def test_retention_keeps_accounts_without_a_segment(lifecycle, params):
    got = rows_of(retention.retention_by_seat_bucket(lifecycle, params))
    assert [(b, n) for b, n, *_ in got] == [("1-5", 1), ("50+", 1), ("6-20", 1), (None, 1)]
    assert got[-1][2] == 100.0  # a1, used on its signup day


def test_trials(make_roles, params):
    def sub(i, account, start, trial):
        return dict(subscription_id=i, account_id=account, start_date=day(start), is_trial=trial)

    roles = make_roles(
        accounts=[dict(account_id=a) for a in ("conv", "both", "twice", "paid", "never", "none")],
        subscriptions=[
            sub("1", "conv", 0, True),
            sub("2", "conv", 14, False),
            sub("3", "both", 0, True),
            sub("4", "both", 0, False),
            sub("5", "twice", 0, True),
            sub("6", "twice", 0, True),
            sub("7", "twice", 7, False),
            sub("8", "paid", 0, False),
            sub("9", "paid", 3, True),
            sub("A", "never", 0, True),
            sub("B", "orphan", 0, True),
        ],
    )
    # "both" starts with a trial by id, but its first day is ambiguous for the conversion
    assert rows_of(growth.growth_trial_structure(roles, params)) == [(4, 1, 6)]
    assert rows_of(growth.growth_trial_conversion(roles, params)) == [(3, 2, 66.7, 10.5)]


def test_activation(make_roles, params):
    roles = make_roles(
        accounts=[
            dict(account_id="a", churn_flag=True),
            dict(account_id="b"),
            dict(account_id="idle"),
            dict(account_id="young", signup_date=date(2024, 7, 1)),
        ],
        subscriptions=[dict(subscription_id=f"s{a}", account_id=a) for a in ("a", "b", "young")],
        feature_usage=[
            dict(subscription_id="sa", usage_date=day(30), feature_name="f1"),
            dict(subscription_id="sa", usage_date=day(31), feature_name="f2"),
            dict(subscription_id="sa", usage_date=day(-1), feature_name="f3"),
            *[dict(subscription_id="sb", usage_date=day(n), feature_name=f"f{n}") for n in range(3)],
            dict(subscription_id="sb", usage_date=day(5), feature_name="f1"),
            dict(subscription_id="syoung", usage_date=date(2024, 7, 2), feature_name="fresh"),
        ],
        churn_events=[dict(account_id="a", churn_date=day(20))],
    )
    assert rows_of(growth.growth_activation_sweep(roles, params)) == [
        (0, 1, 0, 0.0),
        (1, 1, 1, 100.0),
        (3, 1, 0, 0.0),
    ]
    assert rows_of(growth.growth_activation_sweep(roles, params, bounded=True))[0] == (0, 2, 1, 50.0)
    assert rows_of(growth.growth_activation_buckets(roles, params)) == [
        ("0-2", 2, 50.0),
        ("3-5", 1, 0.0),
    ]
    assert rows_of(growth.growth_activation_intensity(roles, params)) == [(1.0, 2.0, 1.0, 2.0)]
    # "fresh" was adopted by an account outside the base only
    adoption = {f: rest for f, *rest in rows_of(behaviour.adoption_rates(roles, params))}
    assert adoption["fresh"] == [0, None, 33.3]
    assert adoption["f1"] == [2, 50.0, 0.0]
    assert adoption["f2"] == [2, 50.0, 0.0]
    assert "f3" not in adoption
    loose = replace(params, adoption_window=(None, 60))
    assert "f3" in {f for f, *_ in rows_of(behaviour.adoption_rates(roles, loose))}
    extract = {r["Feature"]: r for r in marts.mart_feature_metrics(roles, params).collect()}
    assert (extract["f1"]["Adopters"], extract["f1"]["Events"]) == (2, 3)
    assert extract["fresh"]["Delta"] is None
    first, *_ = rows_of(behaviour.behaviour_feature_adoption(roles, params))
    assert first[0] == "f0"


@pytest.fixture(scope="module")
def segments(make_roles):
    """Source event 29 of 96 churned, partner 13 of 89; two industries at the size limit."""
    rows = []
    for source, n, lost in (("event", 96, 29), ("partner", 89, 13)):
        rows += [
            dict(referral_source=source, churn_flag=i < lost, industry=f"big {source}")
            for i in range(n)
        ]
    rows += [dict(referral_source="ads", industry="at the limit") for _ in range(15)]
    rows += [dict(referral_source="ads", industry="below") for _ in range(14)]
    return make_roles(accounts=[dict(account_id=str(i)) | row for i, row in enumerate(rows)])


def test_thin_crosses_are_left_out(segments, params):
    got = rows_of(churn.churn_industry_x_source(segments, params))
    assert got == [
        ("big event", "event", 96, 30.2),
        ("big partner", "partner", 89, 14.6),
        ("at the limit", "ads", 15, 0.0),
    ]
    assert len(rows_of(churn.churn_industry_x_source(segments, replace(params, cross_limit=1)))) == 1


def test_yates_correction_at_one_degree(segments, params):
    test, chi2, dof, p = rows_of(
        stats.stats_chi_square_pairwise(segments, params, "event", "partner")
    )[0]
    assert (test, round(chi2, 3), dof, round(p, 4)) == ("event vs partner", 5.548, 1, 0.0185)


def test_contingency_keeps_empty_cells(segments, params):
    cells = {(s, f): (o, e) for s, f, o, e in rows_of(stats.stats_contingency(segments, params))}
    assert cells["ads", True] == (0, round(29 * 42 / 214, 4))
    assert sum(o for o, _ in cells.values()) == 214
    assert sum(e for _, e in cells.values()) == pytest.approx(214)


def test_single_outcome_cannot_be_tested(make_roles, params):
    roles = make_roles(
        accounts=[dict(account_id=str(i), referral_source=str(i % 2)) for i in range(6)]
    )
    assert rows_of(stats.stats_chi_square(roles, params, ["referral_source"])) == [
        ("referral_source", 0.0, 0, 1.0)
    ]


def test_segment_deltas_sum_to_nothing(segments, params):
    rows = stats.stats_segment_delta(segments, params).filter("segment = 'referral_source'").collect()
    assert sum(r["n"] for r in rows) == 214
    assert {r["segment_value"]: r["delta_pct"] for r in rows}["event"] == 10.6


def test_reason_mix_rows_sum_to_100(make_roles, params):
    reasons = ["price"] * 3 + ["bugs"] + [None]
    roles = make_roles(
        accounts=[dict(account_id="a", plan_tier="Basic"), dict(account_id="b", plan_tier="Odd")],
        churn_events=[dict(account_id=a, reason_code=r) for a in "ab" for r in reasons],
    )
    mix = churn.churn_reason_mix_by_plan(roles, params, reasons=("price", "bugs", "other"))
    assert rows_of(mix) == [("Basic", 75.0, 25.0, 0.0, 0.0)]
    mix = churn.churn_reason_mix_by_plan(roles, params, reasons=("price",))
    assert rows_of(mix) == [("Basic", 75.0, 25.0)]
    shares = rows_of(churn.churn_reasons(roles, params))
    assert shares[0] == ("price", 6, 60.0)


def test_revenue(make_roles, params):
    roles = make_roles(
        accounts=[dict(account_id="a"), dict(account_id="b", industry="health")],
        subscriptions=[
            dict(subscription_id=str(i), account_id=a, plan_tier=p, arr_amount=v, churn_flag=c)
            for i, (a, p, v, c) in enumerate(
                [("a", "Pro", 10.5, True), ("a", "Pro", 20.0, True), ("b", "Basic", 91.5, True),
                 ("b", "Basic", 5.0, False)]
            )
        ],
    )
    assert rows_of(churn.churn_revenue_by_plan(roles, params)) == [
        ("Basic", 1, 100.0, 92.0, 75.0),
        ("Pro", 2, 200.0, 31.0, 25.0),
    ]
    assert rows_of(churn.churn_arr_by_industry(roles, params)) == [
        ("health", 92.0, 1),
        ("retail", 31.0, 1),
    ]
    assert rows_of(marts.mart_plan_impact(roles, params))[0] == ("Basic", 1, 100.0, 91.5)


def test_months_outside_the_window_stay_out(make_roles):
    roles = make_roles(
        accounts=[dict(account_id="a")],
        subscriptions=[
            dict(subscription_id="1", account_id="a", start_date=date(2023, 2, 3)),
            dict(subscription_id="2", account_id="a", start_date=date(2022, 12, 31)),
        ],
    )
    short = Params(window_end=date(2023, 3, 31))
    summary = rows_of(marts.mart_monthly_summary(roles, short))
    assert [m for m, *_ in summary] == ["2023-01", "2023-02", "2023-03"]
    assert [n for _, _, n, *_ in summary] == [0, 1, 0]
    long = rows_of(marts.mart_monthly_mrr_long(roles, short))
    assert long == [
        ("2023-01", "New MRR", 0.0),
        ("2023-02", "New MRR", 100.0),
        ("2023-03", "New MRR", 0.0),
        ("2023-01", "Churned MRR", 0.0),
        ("2023-02", "Churned MRR", 0.0),
        ("2023-03", "Churned MRR", 0.0),
    ]


def test_defaults_cover_24_months(params):
    assert params.months == 24


def test_views(lifecycle, spark):
    lifecycle.register_views()
    assert spark.sql("SELECT count(*) FROM accounts a JOIN churn_events USING (account_id)").first()[0] == 4
    assert spark.table("support_tickets").agg(F.count("*")).first()[0] == 4


def test_usage_of_unknown_features_counts(make_roles, params):
    usage = [dict(subscription_id="s", feature_key=k) for k in (1, 1, 2, 3)]
    roles = make_roles(
        accounts=[dict(account_id="a")], subscriptions=[dict(subscription_id="s", account_id="a")]
    )
    spark = roles.accounts.sparkSession
    full = [(u["subscription_id"], u["feature_key"], date(2023, 1, 15), 1, 3600, 1, False) for u in usage]
    schema = (
        "subscription_id string, feature_key long, usage_date date, usage_count long,"
        " usage_duration_secs long, error_count long, is_beta_feature boolean"
    )
    features = spark.createDataFrame([(1, "one"), (2, "two")], "feature_key long, feature_name string")
    roles = replace(roles, feature_usage=spark.createDataFrame(full, schema), features=features)
    row = behaviour.behaviour_usage_by_outcome(roles, params).first()
    assert (row["avg_events"], row["avg_feats"], row["avg_errors"]) == (4.0, 2.0, 4.0)
    (account,) = marts.mart_account_metrics(roles, params).collect()
    assert (account["Events"], account["Distinct Features"]) == (4, 2)
    assert behaviour.behaviour_error_rate(roles, params).first()["avg_errors"] == 4.0
    names = {r["feature_name"] for r in behaviour.feature_adoption(roles, params).collect()}
    assert names == {"one", "two"}


def test_small_and_large_money(make_roles, params):
    money = [0.00004, 0.00004, 2e14]
    roles = make_roles(
        accounts=[dict(account_id="a", churn_flag=True)],
        subscriptions=[
            dict(subscription_id=str(i), account_id="a", mrr_amount=m, arr_amount=m, churn_flag=True)
            for i, m in enumerate(money)
        ],
        churn_events=[dict(account_id="a", refund_amount_usd=m) for m in money],
    )
    total = 2e14 + 0.00008
    assert kpis.kpi_mrr_by_plan(roles, params).first()["churned_mrr"] == 2e14
    assert churn.lost_revenue(roles).first()["arr"] == total
    assert churn.churn_arr_by_industry(roles, params).first()["arr_lost"] == 2e14
    assert churn.churn_refunds(roles, params).first()["max_refund"] == 2e14
    assert marts.mart_plan_impact(roles, params).first()["Arr Lost"] == 2e14


def test_row_counts_match_the_extracts(make_roles, params):
    roles = make_roles(
        accounts=[
            dict(account_id="a"),
            dict(account_id="b", signup_date=date(2023, 4, 1), referral_source=None),
        ],
        subscriptions=[
            dict(subscription_id="s", account_id="a", churn_flag=True),
            dict(subscription_id="t", account_id="b", plan_tier="Basic", churn_flag=True),
        ],
        feature_usage=[dict(subscription_id="s"), dict(subscription_id="t", feature_name="f2")],
        churn_events=[dict(account_id="a"), dict(account_id="b", reason_code=None)],
    )
    counts = {r["extract"]: r["rows"] for r in marts.mart_row_counts(roles, params).collect()}
    assert counts == {name: build(roles, params).count() for name, build in marts.MARTS.items()}


def test_months_of_use_travel_as_bits(make_roles, params):
    """One row per account and era in the exchange, however many months were active."""
    roles = make_roles(
        accounts=[dict(account_id=a, signup_date=date(2019, 1, 1)) for a in "ab"],
        subscriptions=[
            dict(subscription_id=s, account_id=s[0], start_date=date(2019, 1, 1)) for s in ("a1", "b1")
        ],
        feature_usage=[
            dict(subscription_id=s, usage_date=date(y, m, 1))
            for s in ("a1", "b1")
            for y in (2019, 2020, 2023, 2024)
            for m in range(1, 13)
            if s == "a1" or m % 2
        ],
    )
    seen = kpis.months_seen(roles, params)
    assert sorted((r.account_id, bin(r.seen).count("1")) for r in seen.collect()) == [
        ("a", 12), ("a", 36), ("b", 6), ("b", 18)
    ]
    active = rows_of(kpis.kpi_monthly_active_accounts(roles, params))
    assert active == [
        (date(y, m, 1), 1 + m % 2) for y in (2019, 2020, 2023, 2024) for m in range(1, 13)
    ]
    for df in (
        kpis.kpi_monthly_active_accounts(roles, params),
        retention.retention_cohort_matrix(roles, params),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_bit_or" in plan
        keys = [line for line in plan.splitlines() if "partial_bit_or" in line]
        assert all("month" not in line.split("functions")[0].replace("cohort_month", "") for line in keys)
