"""Key statistics beside a table: no job while planning, files sketched once, heavy keys split."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F
from row_values import rows_of

from stayrate.operators import kpis, marts, retention
from stayrate.plans import keystats
from stayrate.plans.joins import lookup
from stayrate.roles import TABLES, Roles, analyze_keys
from stayrate.sources.retail import PARAMS, retail_roles

FOLDER = "/root/testdata/sf0.001"


def usage(spark, path, first, last, mode="append"):
    """Rows of which every third belongs to key 7, in one more file."""
    rows = spark.range(first, last).withColumn(
        "k", F.expr("IF(id % 3 = 0, 7L, 100 + id % 4000)")
    )
    rows.coalesce(1).write.mode(mode).parquet(path)


def test_frequent_values_are_listed(spark, tmp_path):
    usage(spark, f"{tmp_path}/t", 0, 9000)
    usage(spark, f"{tmp_path}/t", 9000, 12000)
    df = spark.read.parquet(f"{tmp_path}/t").selectExpr("k AS key", "CAST(id % 5 AS STRING) AS s", "id")
    stats = f"file://{tmp_path}/stats"
    assert keystats.analyze_table(df, ["key", "s"], stats) == 2
    found = keystats.known_hot_keys(spark, stats, share=0.01, min_rows=100)
    assert found["key"] == [(7, 34)]
    assert sorted(found["s"]) == [(str(i), 20) for i in range(5)]
    assert keystats.known_hot_keys(spark, stats, share=0.01, min_rows=10**6) == {"key": [], "s": []}


def test_only_new_files_are_sketched(spark, tmp_path, monkeypatch):
    path, stats = f"{tmp_path}/with space/t", f"file://{tmp_path}/stats"
    usage(spark, path, 0, 9000)
    assert keystats.analyze_table(spark.read.parquet(path), ["k"], stats) == 1
    usage(spark, path, 9000, 15000)
    df = spark.read.parquet(path)
    assert keystats.analyze_table(df, ["k"], stats) == 1
    assert keystats.analyze_table(df, ["k"], stats) == 0
    once = (tmp_path / "stats" / "frequent.json").read_text()
    assert keystats.analyze_table(df, ["k"], f"file://{tmp_path}/anew") == 2
    anew = (tmp_path / "anew" / "frequent.json").read_text()
    first = lambda text: [json.loads(text)["rows"], json.loads(text)["keys"]["k"][0]]
    assert first(once) == first(anew) == [15000, [7, 5000]]


def test_files_that_are_gone_do_not_count(spark, tmp_path):
    path, stats = f"{tmp_path}/t", f"file://{tmp_path}/stats"
    usage(spark, path, 0, 9000)
    keystats.analyze_table(spark.read.parquet(path), ["k"], stats)
    spark.range(50).withColumnRenamed("id", "k").write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    keystats.analyze_table(df, ["k"], stats)
    found = json.loads((tmp_path / "stats" / "frequent.json").read_text())
    assert found["rows"] == 50 and [7, 3000] not in found["keys"]["k"]


@pytest.mark.parametrize("rows", [[], [(None,)], [(1,), (1,), (None,)]])
def test_frames_without_files(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "k bigint")
    for _ in "ab":
        keystats.analyze_table(df, ["k"], f"file://{tmp_path}/stats")
    found = keystats.known_hot_keys(spark, f"file://{tmp_path}/stats", 0.001, 1)
    assert found == {"k": [(1, 2)] if (1,) in rows else []}


def jobs_of(spark, build) -> list[int]:
    """Ids of the Spark jobs that ``build`` runs."""
    context = spark.sparkContext
    group = f"plan-{id(build)}"
    context.setJobGroup(group, "")
    try:
        build()
        return list(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_planning_runs_no_job(spark, tmp_path):
    analyzed = analyze_keys(retail_roles(spark, FOLDER, hot_min_rows=2), f"file://{tmp_path}/stats")

    def build():
        roles = retail_roles(spark, FOLDER, key_stats=analyzed.key_stats, hot_min_rows=2)
        marts.mart_account_metrics(roles, PARAMS)
        assert roles.hot("feature_usage", "subscription_id")

    assert jobs_of(spark, build) == []
    assert jobs_of(spark, lambda: retail_roles(spark, FOLDER).hot("subscriptions", "account_id"))


def test_no_statistics_means_plain_joins(spark, tmp_path):
    for stats in ("", f"file://{tmp_path}/none"):
        roles = retail_roles(spark, FOLDER, key_stats=stats, hot_min_rows=2)
        assert roles.hot("feature_usage", "subscription_id") == []
        plan = retention.retention_by_source(roles, PARAMS)._jdf.queryExecution().optimizedPlan()
        assert "_piece" not in plan.toString()


def test_results_with_statistics(spark, tmp_path):
    plain = retail_roles(spark, FOLDER, key_stats="")
    split = analyze_keys(retail_roles(spark, FOLDER, hot_min_rows=2), f"file://{tmp_path}/stats")
    assert split.hot("feature_usage", "feature_key") and split.hot("subscriptions", "account_id")
    for operator in (kpis.kpi_support_load, marts.mart_account_metrics):
        assert sorted(rows_of(operator(split, PARAMS)), key=repr) == sorted(
            rows_of(operator(plain, PARAMS)), key=repr
        )


def test_string_keys(spark, make_roles, params, tmp_path):
    roles = make_roles(
        accounts=[dict(account_id="a'\"ä")],
        subscriptions=[dict(subscription_id="s", account_id="a'\"ä")] * 3,
        feature_usage=[dict(subscription_id="s", usage_date=date(2023, 2, 1))] * 5,
    )
    roles.hot_min_rows = 2
    split = analyze_keys(roles, f"file://{tmp_path}/stats")
    assert split.hot("subscriptions", "account_id") == [("a'\"ä", 2)]
    got = kpis.kpi_monthly_active_accounts(split, params)
    assert rows_of(got) == [(date(2023, 2, 1), 1)]


def test_hot_key_of_one_file_fills_every_piece(spark, tmp_path):
    """A key whose rows all lie in one file is dealt to as many tasks as it has pieces."""
    path, stats = f"{tmp_path}/t", f"file://{tmp_path}/stats"
    spark.range(20_000).withColumn("k", F.lit(7).cast("bigint")).coalesce(1).write.parquet(path)
    fact = spark.read.parquet(path)
    keystats.analyze_table(fact, ["k"], stats)
    ((value, pieces),) = keystats.known_hot_keys(spark, stats, 0.1, 1)["k"]
    assert (value, pieces) == (7, 10)
    dim = spark.createDataFrame([(7, "d")], "k bigint, v string")
    joined = lookup(fact, dim, "k", [(value, pieces)])
    assert "_piece" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 20_000
    piece = F.pmod(F.xxhash64("id", "k"), F.lit(pieces))
    assert fact.groupBy(piece.alias("p")).count().count() == pieces


def test_analyzing_and_copying_make_no_other_table(spark, tmp_path):
    made = []

    def noted(name):
        def make(roles):
            made.append(name)
            return retail_roles(spark, FOLDER).table(name)

        return make

    roles = Roles(**{name: noted(name) for name in TABLES}, hot_min_rows=2)
    analyzed = analyze_keys(roles, f"file://{tmp_path}/stats")
    assert made == ["feature_usage", "subscriptions"] and analyzed._hot == {}
    other = roles.but(owned=analyzed.subscriptions)
    assert other.owned is analyzed.subscriptions and roles.owned is None
    assert made == ["feature_usage", "subscriptions"]
