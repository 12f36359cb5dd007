"""Sources, extracts and the prepared usage table."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from row_values import rows_of
from pyspark.sql import types as T

from stayrate.catalog import operators
from stayrate.operators import growth
from stayrate.operators.dashboard import WORKSHEETS, mart_dashboard_long
from stayrate.operators.facts import Facts, SharedFacts
from stayrate.operators.marts import MART_SCHEMAS, MARTS, mart_row_counts
from stayrate.plans import files
from stayrate.plans.joins import small_sides_hashed
from stayrate.sinks import extracts, prepared
from stayrate.sinks.extracts import (
    BrokenExtract,
    dashboard_from_extracts,
    read_extract,
    write_extract,
    write_extracts,
)
from stayrate.sinks.prepared import prepare_usage, update_usage
from stayrate.sinks.roles import write_csv_roles
from stayrate.sources.retail import PARAMS, retail_roles
from stayrate.sources.tables import (
    count_rejects,
    read_csv_table,
    read_roles,
    role_schema,
    split_csv_roles,
    split_csv_table,
)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def roles(spark):
    return retail_roles(spark, FOLDER)


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    files = {
        "accounts": "churn_flag,account_id,signup_date,seats,industry,country,referral_source,"
        "plan_tier,is_trial,account_name,extra\nTrue,A-1,2023-01-05,,retail,US,ads,Pro,False,,x\n",
        "subscriptions": "subscription_id,account_id,start_date,end_date,plan_tier,seats,"
        "mrr_amount,arr_amount,is_trial,upgrade_flag,downgrade_flag,churn_flag,"
        "billing_frequency,auto_renew_flag\n"
        "S-1,A-1,2023-01-05,,Pro,3,10.5,126,False,True,False,False,monthly,True\n",
        "feature_usage": "usage_id,subscription_id,usage_date,feature_name,usage_count,"
        "usage_duration_secs,error_count,is_beta_feature\nU-1,S-1,2023-02-01,feature_1,3,90,0,True\n",
        "support_tickets": "ticket_id,account_id,submitted_at,closed_at,resolution_time_hours,"
        "priority,first_response_time_minutes,satisfaction_score,escalation_flag\n"
        "T-1,A-1,2023-03-01 10:30:00,,2.5,high,7,,False\n",
        "churn_events": "churn_event_id,account_id,churn_date,reason_code,refund_amount_usd,"
        "is_reactivation,feedback_text\nC-1,A-1,2023-05-01,price,0.0,False,\"too dear, sorry\"\n",
    }
    for name, text in files.items():
        (tmp_path / f"raw_{name}.csv").write_text(text)
    got = read_roles(spark, str(tmp_path), "csv", prefix="raw_")
    for name in files:
        assert got.table(name).schema == role_schema(name)
    (account,) = got.accounts.collect()
    assert (account.account_id, account.signup_date, account.seats) == ("A-1", date(2023, 1, 5), None)
    assert account.churn_flag is True and account.account_name is None
    (ticket,) = got.tickets.collect()
    assert ticket.submitted_at == datetime(2023, 3, 1, 10, 30)
    assert got.churn_events.first().feedback_text == "too dear, sorry"


def test_parquet_roles_give_the_same_answers(spark, roles, tmp_path):
    for name in ("accounts", "subscriptions", "support_tickets", "churn_events"):
        roles.table(name).write.parquet(f"{tmp_path}/{name}.parquet")
    usage = roles.feature_usage.join(roles.features, "feature_key").drop("feature_key")
    usage.write.parquet(f"{tmp_path}/feature_usage.parquet")
    stored = read_roles(spark, str(tmp_path), id_type=T.LongType())
    everything = operators(("1-URGENT", "5-LOW"), ("ASIA", "EUROPE"))
    for name in ("mart_account_metrics", "mart_feature_metrics", "growth_activation_sweep"):
        assert sorted(rows_of(everything[name](stored, PARAMS)), key=repr) == sorted(
            rows_of(everything[name](roles, PARAMS)), key=repr
        )


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_extracts_come_back_as_written(spark, roles, tmp_path, fmt):
    written = write_extracts(roles, PARAMS, str(tmp_path), fmt)
    assert written == dict(rows_of(mart_row_counts(roles, PARAMS)))
    for name, build in MARTS.items():
        back = read_extract(spark, str(tmp_path), name, fmt)
        want = build(roles, PARAMS)
        assert back.dtypes == want.dtypes
        clean = (lambda r: tuple(v or None for v in r)) if fmt == "csv" else tuple
        assert sorted(map(clean, back.collect()), key=repr) == sorted(
            map(clean, want.collect()), key=repr
        )
    again = dashboard_from_extracts(spark, str(tmp_path), fmt)
    assert sorted(rows_of(again), key=repr) == sorted(
        rows_of(mart_dashboard_long(roles, PARAMS)), key=repr
    )


def test_empty_extract_counts_zero(spark, tmp_path):
    empty = spark.createDataFrame([], MART_SCHEMAS["plan_impact"])
    for fmt in ("parquet", "csv"):
        folder = f"{tmp_path}/{fmt}"
        assert write_extract(empty, f"{folder}/plan_impact", fmt) == 0
        assert read_extract(spark, folder, "plan_impact").collect() == []


PLAN_IMPACT = [("Pro", 2, 10.5, 126.0), ("Basic", 1, 1.0, 12.0)]


def plan_impact(spark, rows=PLAN_IMPACT):
    return spark.createDataFrame(rows, MART_SCHEMAS["plan_impact"])


def test_write_that_dies_leaves_the_old_extract(spark, tmp_path):
    path = f"{tmp_path}/plan_impact"
    write_extract(plan_impact(spark), path)
    dying = plan_impact(spark, [("Pro", 9, 9.0, 9.0)]).selectExpr(
        "Plan", "`Churned Subs`", "`Mrr Lost`", "if(`Arr Lost` > 1, raise_error('lost'), 1D) AS `Arr Lost`"
    )
    with pytest.raises(Exception, match="lost"):
        write_extract(dying, path)
    assert len(list((tmp_path / "plan_impact").glob("attempt-*"))) == 2
    assert sorted(rows_of(read_extract(spark, str(tmp_path), "plan_impact"))) == sorted(PLAN_IMPACT)
    write_extract(plan_impact(spark, [("Pro", 1, 1.0, 1.0)]), path)
    assert rows_of(read_extract(spark, str(tmp_path), "plan_impact")) == [("Pro", 1, 1.0, 1.0)]


def test_write_that_dies_before_its_manifest(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/plan_impact"
    write_extract(plan_impact(spark), path)

    def dies(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(extracts, "replace_text", dies)
    with pytest.raises(KeyboardInterrupt):
        write_extract(plan_impact(spark, [("Pro", 1, 1.0, 1.0)]), path)
    assert len(rows_of(read_extract(spark, str(tmp_path), "plan_impact"))) == 2


def test_first_write_that_dies_leaves_no_extract(spark, tmp_path):
    (tmp_path / "plan_impact" / "attempt-1").mkdir(parents=True)
    with pytest.raises(BrokenExtract, match="no manifest"):
        read_extract(spark, str(tmp_path), "plan_impact")


def test_readers_of_the_extract_before_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/plan_impact"
    write_extract(plan_impact(spark), path)
    before = read_extract(spark, str(tmp_path), "plan_impact")
    write_extract(plan_impact(spark, []), path)
    assert before.count() == 2
    for _ in "ab":
        write_extract(plan_impact(spark, []), path)
    assert len(list((tmp_path / "plan_impact").glob("attempt-*"))) == 2


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("harm", ["cut", "lost", "added", "rows", "columns", "format"])
def test_harmed_extracts_are_refused(spark, tmp_path, fmt, harm):
    path = tmp_path / "plan_impact"
    write_extract(plan_impact(spark).repartition(2), str(path), fmt)
    (attempt,) = path.glob("attempt-*")
    part = sorted(attempt.glob("part-*"))[0]
    manifest = json.loads((path / "manifest.json").read_text())
    if harm == "cut":
        part.write_bytes(part.read_bytes()[:-2])
    elif harm == "lost":
        part.unlink()
    elif harm == "added":
        (attempt / f"part-9{part.suffix}").write_bytes(part.read_bytes())
    elif harm == "rows":
        manifest["rows"] += 1
    elif harm == "columns":
        manifest["columns"][0][0] = "Other"
    files.replace_text(spark, f"{path}/manifest.json", json.dumps(manifest))
    with pytest.raises(BrokenExtract):
        read_extract(spark, str(tmp_path), "plan_impact", "orc" if harm == "format" else None)


def test_dashboard_of_a_truncated_extract_is_refused(spark, roles, tmp_path):
    write_extracts(roles, PARAMS, str(tmp_path))
    (attempt,) = (tmp_path / "churn_reasons").glob("attempt-*")
    for part in attempt.glob("part-*"):
        part.write_bytes(part.read_bytes()[: part.stat().st_size // 2])
    with pytest.raises(BrokenExtract, match="churn_reasons"):
        dashboard_from_extracts(spark, str(tmp_path))


def test_23_worksheets_on_8_extracts():
    sheets = {(board, name) for rows in WORKSHEETS.values() for board, name, *_ in rows}
    assert len(sheets) == 23
    assert len({board for board, _ in sheets}) == 4
    assert set(WORKSHEETS) == set(MARTS)


def test_prepared_usage_changes_no_result(spark, roles, tmp_path):
    ready = prepare_usage(roles, str(tmp_path))
    everything = operators(("1-URGENT", "5-LOW"), ("ASIA", "EUROPE"))
    for name in (
        "dq_usage_after_churn",
        "growth_activation_sweep_365d",
        "retention_by_seat_bucket",
        "retention_cohort_matrix_unbounded",
        "behaviour_usage_by_outcome",
        "behaviour_feature_adoption",
        "mart_account_metrics",
        "mart_feature_metrics",
    ):
        assert sorted(rows_of(everything[name](ready, PARAMS)), key=repr) == sorted(
            rows_of(everything[name](roles, PARAMS)), key=repr
        ), name
    plan = everything["kpi_monthly_active_accounts"](ready, PARAMS)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_prepared_usage_goes_below_the_checkpoint_folder(spark, roles):
    shared = files.shared_folder(spark).removeprefix("file://")
    paths = {prepare_usage(roles).owned.inputFiles()[0].split("/owned_usage")[0] for _ in "ab"}
    assert len(paths) == 2
    assert all(f"{shared}/stayrate-" in path for path in paths)


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    monkeypatch.setattr(files, "shared_folder", lambda spark: None)
    with pytest.raises(ValueError, match="checkpoint"):
        files.new_folder(spark, "usage")


def test_small_files_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a/x.json"
    assert files.read_text(spark, path) is None
    for content in ("one", "zwei \u00e4\n" * 9000, ""):
        files.replace_text(spark, path, content)
        assert files.read_text(spark, path) == content
    assert [name for name, *_ in files.children(spark, f"file://{tmp_path}/a")] == ["x.json"]


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n2,1\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    with pytest.raises(Exception, match="CSV header"):
        read_csv_table(spark, str(tmp_path), schema).collect()


def test_prepared_usage_reads_only_the_months_it_needs(spark, make_roles, params, tmp_path):
    roles = make_roles(
        accounts=[dict(account_id="a")],
        subscriptions=[dict(subscription_id="s", account_id="a")],
        feature_usage=[
            dict(subscription_id="s", usage_date=date(2023, m, 15)) for m in range(1, 12)
        ],
    )
    prepared = prepare_usage(roles, str(tmp_path / "usage"))
    df = growth.early_usage(prepared, params)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_month" in plan
    assert df.count() == growth.early_usage(roles, params).count()


EVENTS = role_schema("churn_events")
HEADER = "churn_event_id,extra,churn_date,account_id,reason_code,refund_amount_usd,is_reactivation,feedback_text\n"


def test_broken_lines_are_set_apart(spark, tmp_path):
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "a.csv").write_text(
        HEADER
        + "1,x,2023-01-05,A,price,0.5,True,fine\n"
        + "2,x,2023-02-30,A,price,0.5,True,no such day\n"
        + "3,x,2023-01-05,A,price,much,maybe,\n"
        + "4,x,2023-01-05\n"
        + "5,x,2023-01-05,A,price,0.5,True,fine,too many\n"
        + '6,,,,,,,"quoted, with a comma"\n'
    )
    (tmp_path / "events" / "b.csv").write_text(HEADER + "7,x,day,A,price,1e3,FALSE,\n")
    good, rejects = split_csv_table(spark, f"{tmp_path}/events", EVENTS, "churn_events")
    assert good.schema.fieldNames() == EVENTS.fieldNames()
    assert [f.dataType for f in good.schema] == [f.dataType for f in EVENTS]
    assert sorted(good.select("churn_event_id", "churn_date", "feedback_text").collect()) == [
        ("1", date(2023, 1, 5), "fine"),
        ("6", None, "quoted, with a comma"),
    ]
    assert good.count() == 2 and good.select("churn_event_id").count() == 2
    lines = {(r.file[-5:], tuple(r.columns)): r.record for r in rejects.collect()}
    assert set(lines) == {
        ("a.csv", ("churn_date",)),
        ("a.csv", ("refund_amount_usd", "is_reactivation")),
        ("a.csv", ()),
        ("b.csv", ("churn_date",)),
    }
    assert sorted(r.record for r in rejects.filter("size(columns) = 0").collect()) == [
        "4,x,2023-01-05", "5,x,2023-01-05,A,price,0.5,True,fine,too many"
    ]
    assert json.loads(lines["b.csv", ("churn_date",)])["churn_event_id"] == "7"
    counts = {r.file[-5:]: (r.table, r.rejected, r.columns) for r in count_rejects(rejects).collect()}
    assert counts == {
        "a.csv": ("churn_events", 4, ["churn_date", "is_reactivation", "refund_amount_usd"]),
        "b.csv": ("churn_events", 1, ["churn_date"]),
    }


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("churn_event_id,account_id\n1,A\n")
    with pytest.raises(ValueError, match="churn_date, reason_code"):
        split_csv_table(spark, f"{tmp_path}/a.csv", EVENTS)


def test_roles_through_csv(spark, roles, tmp_path):
    write_csv_roles(roles, str(tmp_path), "raw_")
    found, rejects = split_csv_roles(spark, str(tmp_path), "raw_", T.LongType())
    assert rejects.count() == 0
    for name in ("accounts", "churn_events", "support_tickets"):
        want = roles.table(name).select(found.table(name).columns)
        kinds = [f"CAST({c} AS {t}) AS {c}" for c, t in found.table(name).dtypes]
        got = sorted(rows_of(found.table(name)), key=repr)
        assert got == sorted(rows_of(want.selectExpr(*kinds)), key=repr), name


@pytest.fixture
def usage_tables():
    """Rows of a small warehouse: two accounts with usage in six months, one without usage."""
    return dict(
        accounts=[dict(account_id=a) for a in ("a", "b", "idle")],
        subscriptions=[
            dict(subscription_id=f"s{a}", account_id=a) for a in ("a", "b", "idle", "late")
        ],
        feature_usage=[
            dict(subscription_id=f"s{a}", usage_date=date(2023, m, 15), usage_count=m)
            for m in range(1, 13)
            for a in ("a" if m <= 6 else "b", "late" if m == 12 else "b")
        ],
        churn_events=[dict(account_id="a", churn_date=date(2023, 8, 1))],
    )


def prepared_rows(roles):
    return sorted(map(repr, roles.owned.select(sorted(roles.owned.columns)).collect()))


def months(*numbers):
    return [date(2023, m, 1) for m in numbers]


@pytest.mark.parametrize(
    ("change", "rewritten"),
    [
        ("nothing", []),
        ("new usage", [3, 11]),
        ("first usage of a month", [1]),
        ("churned", [1, 2, 3, 4, 5, 6]),
        ("renamed without usage", []),
        ("new account", [12]),
        ("account gone", [1, 2, 3, 4, 5, 6]),
        ("usage removed", [7]),
    ],
)
def test_updated_usage_equals_a_rebuild(spark, make_roles, usage_tables, tmp_path, change, rewritten):
    tables = usage_tables
    folder = f"{tmp_path}/usage"
    prepare_usage(make_roles(**tables), folder)
    files_before = {
        p.name: {f.name for f in p.glob("part-*")} for p in (tmp_path / "usage" / "owned_usage").glob("usage_month=*")
    }
    new = []
    if change == "new usage":
        new = [dict(subscription_id=s, usage_date=date(2023, m, 20)) for s, m in (("sa", 3), ("sb", 11))]
    elif change == "first usage of a month":
        new = [dict(subscription_id="sidle", usage_date=date(2023, 1, 20))]
    elif change == "churned":
        tables["accounts"][0]["churn_flag"] = True
    elif change == "renamed without usage":
        tables["accounts"][2]["industry"] = "health"
    elif change == "new account":
        tables["accounts"].append(dict(account_id="late"))
    elif change == "account gone":
        del tables["accounts"][0]
    elif change == "usage removed":
        new = [u for u in tables["feature_usage"] if u["usage_date"].month == 7]
        tables["feature_usage"] = [u for u in tables["feature_usage"] if u not in new]
    if change != "usage removed":
        tables["feature_usage"] += new
    roles = make_roles(**tables)
    added = make_roles(feature_usage=new).feature_usage
    updated, touched = update_usage(roles, folder, added)
    assert touched == months(*rewritten)
    rebuilt = prepare_usage(roles, f"{tmp_path}/anew")
    assert prepared_rows(updated) == prepared_rows(rebuilt)
    for place in (tmp_path / "usage" / "owned_usage").glob("usage_month=*"):
        kept = files_before.get(place.name) == {f.name for f in place.glob("part-*")}
        assert kept == (date.fromisoformat(place.name[-10:]) not in touched), place.name
    again, touched = update_usage(roles, folder, added.limit(0))
    assert touched == [] and prepared_rows(again) == prepared_rows(rebuilt)


def test_update_that_dies_is_made_good(spark, make_roles, usage_tables, params, tmp_path, monkeypatch):
    folder = f"{tmp_path}/usage"
    prepare_usage(make_roles(**usage_tables), folder)
    usage_tables["accounts"][0]["churn_flag"] = True
    roles = make_roles(**usage_tables)
    none = make_roles().feature_usage

    def dies(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(prepared, "_write_spans", dies)
        with pytest.raises(KeyboardInterrupt):
            update_usage(roles, folder, none)
    updated, touched = update_usage(roles, folder, none)
    assert touched == months(1, 2, 3, 4, 5, 6)
    assert prepared_rows(updated) == prepared_rows(prepare_usage(roles, f"{tmp_path}/anew"))
    with pytest.raises(ValueError, match="no prepared usage"):
        update_usage(roles, f"{tmp_path}/elsewhere", none)


def test_extracts_read_usage_reduced_to_accounts(spark, make_roles, params, tmp_path):
    """Cells are reduced to accounts once, not again for each extract that needs accounts."""
    roles = make_roles(
        accounts=[dict(account_id="a"), dict(account_id="b")],
        subscriptions=[dict(subscription_id="s", account_id="a")],
        feature_usage=[dict(subscription_id="s"), dict(subscription_id="unknown")],
    )
    facts = SharedFacts(roles, params, str(tmp_path))
    for table in (
        facts.usage_per_account(),
        facts.monthly_active(),
        facts.retention("cohort_month"),
        facts.retention("referral_source"),
    ):
        folders = {file.rsplit("/", 2)[1] for file in table.inputFiles()}
        assert "usage" in folders and "cells" not in folders
    assert sorted(facts.usage_per_account().columns) == sorted(
        Facts(roles, params).usage_per_account().columns
    )
    assert [tuple(r)[:3] for r in facts.usage_per_account().collect()] == [("a", 1, 1)]


def test_small_sides_are_hashed_only_inside(spark):
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(key)
    try:
        for value, inside in (("0", "64m"), ("5m", "5m")):
            spark.conf.set(key, value)
            with small_sides_hashed(spark):
                assert spark.conf.get(key) == inside
            assert spark.conf.get(key) == value
    finally:
        spark.conf.set(key, before)
