from __future__ import annotations

import sys
from datetime import date, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import types as T  # noqa: E402

from stayrate.params import Params  # noqa: E402
from stayrate.plans.session import build_session  # noqa: E402
from stayrate.roles import TABLES, Roles  # noqa: E402
from stayrate.sources.tables import role_schema  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        spark__master="local[4]",
        spark__driver__memory="4g",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = {
    "accounts": dict(
        account_name="name",
        industry="retail",
        country="US",
        signup_date=date(2023, 1, 10),
        referral_source="ads",
        plan_tier="Pro",
        seats=10,
        is_trial=False,
        churn_flag=False,
    ),
    "subscriptions": dict(
        start_date=date(2023, 1, 10),
        end_date=None,
        plan_tier="Pro",
        billing_frequency="monthly",
        mrr_amount=100.0,
        arr_amount=1200.0,
        is_trial=False,
        upgrade_flag=False,
        downgrade_flag=False,
        churn_flag=False,
        auto_renew_flag=True,
    ),
    "feature_usage": dict(
        usage_id="u",
        feature_name="f1",
        usage_date=date(2023, 1, 15),
        usage_count=1,
        usage_duration_secs=3600,
        error_count=0,
        is_beta_feature=False,
    ),
    "support_tickets": dict(
        ticket_id="t",
        submitted_at=datetime(2023, 2, 1, 12),
        closed_at=None,
        resolution_time_hours=1.0,
        priority="low",
        first_response_time_minutes=5.0,
        satisfaction_score=None,
        escalation_flag=False,
    ),
    "churn_events": dict(
        churn_event_id="c",
        churn_date=date(2023, 6, 1),
        reason_code="price",
        refund_amount_usd=0.0,
        is_reactivation=False,
        feedback_text=None,
    ),
}


@pytest.fixture(scope="session")
def make_roles(spark):
    """Roles from lists of partial rows; everything not given takes a default."""

    def build(id_type=T.StringType(), **rows) -> Roles:
        frames = {}
        for table in TABLES:
            schema = role_schema(table, id_type)
            full = [DEFAULTS[table] | row for row in rows.get(table, [])]
            data = [tuple(row.get(name) for name in schema.fieldNames()) for row in full]
            frames[table] = spark.createDataFrame(data, schema)
        return Roles(**frames)

    return build


@pytest.fixture
def params() -> Params:
    return Params()
