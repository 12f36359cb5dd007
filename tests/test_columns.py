from __future__ import annotations

import math
import random
from datetime import date
from decimal import Decimal

import duckdb
import pytest
from row_values import rows_of
from pyspark.sql import functions as F

from stayrate.functions.columns import (
    _LIMB_PLACES,
    _limb,
    banded,
    bucketize,
    exact_avg,
    exact_sum,
    month_index,
    pct,
    rnd,
    text,
    within,
)
from stayrate.functions.distributions import chi_square_p, erfc_of_root


def test_rounding_scales_first(spark):
    df = spark.createDataFrame([(0.285,), (2.5,), (-2.5,), (None,)], "x double")
    assert rows_of(df.selectExpr(rnd("x", 2), rnd("x"))) == [
        (0.28, 0.0),
        (2.5, 3.0),
        (-2.5, -3.0),
        (None, None),
    ]


def test_pct_of_nothing_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 3)], "a long, b long")
    assert rows_of(df.selectExpr(pct("a", "b"))) == [(None,), (33.3,)]


def test_month_index_counts_calendar_months(spark):
    df = spark.createDataFrame(
        [
            (date(2023, 1, 31), date(2023, 2, 1)),
            (date(2023, 12, 31), date(2024, 1, 1)),
            (date(2023, 3, 1), date(2023, 3, 31)),
            (date(2023, 3, 1), date(2023, 2, 28)),
        ],
        "a date, b date",
    )
    got = df.selectExpr(month_index("a", "b"))
    assert rows_of(got) == [(1,), (1,), (0,), (-1,)]


def test_buckets(spark):
    seats = [None, 0, 5, 6, 20, 21, 50, 51, 1000]
    df = spark.createDataFrame([(s,) for s in seats], "seats int")
    labels = ("1-5", "6-20", "21-50", "50+")
    got = df.selectExpr(bucketize("seats", (5, 20, 50), labels))
    want = [None, "1-5", "1-5", "6-20", "6-20", "21-50", "21-50", "50+", "50+"]
    assert [row[0] for row in got.collect()] == want
    assert banded(labels) == ["A 1-5", "B 6-20", "C 21-50", "D 50+"]


def test_money_sums_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(0.1,)] * 1000 + [(1e11,), (-1e11,)], "x double")
    for parts in (1, 7):
        assert rows_of(df.repartition(parts).agg(F.expr(exact_sum("x")))) == [(100.0,)]
    assert rows_of(df.limit(10).agg(F.expr(exact_avg("x")))) == [(0.1,)]


def test_texts_and_windows(spark):
    label = "it's a \\ 'quote'"
    assert spark.range(1).selectExpr(text(label)).first()[0] == label
    df = spark.createDataFrame([(-1,), (0,), (30,), (31,), (None,)], "d int")
    got = df.selectExpr(within("d", (0, 30)), within("d", (None, 30)))
    assert rows_of(got) == [
        (False, True),
        (True, True),
        (True, True),
        (False, False),
        (None, None),
    ]


@pytest.mark.parametrize(
    ("x", "dof", "p"),
    [  # published table values
        (3.841458820694124, 1, 0.05),
        (5.991464547107979, 2, 0.05),
        (7.814727903251179, 3, 0.05),
        (9.487729036781154, 4, 0.05),
        (23.209251158954356, 10, 0.01),
        (21.665994333461924, 9, 0.01),
        (0.0, 4, 1.0),
    ],
)
def test_chi_square_p(spark, x, dof, p):
    assert tail(spark, x, dof) == pytest.approx(p, rel=1e-9)


def test_chi_square_p_edges(spark):
    assert tail(spark, None, 1) is None
    assert tail(spark, 1.0, None) is None
    assert tail(spark, 1.0, 0) == 1.0
    assert 0 < tail(spark, 1000.0, 5) < 1e-200
    assert tail(spark, 1e6, 7) == 0.0


@pytest.mark.parametrize("half", [1e-6, 0.3, 1.9, 2.0, 2.1, 9.0, 200.0])
def test_erfc(spark, half):
    got = spark.range(1).selectExpr(erfc_of_root(f"{half}D")).first()[0]
    assert got == pytest.approx(math.erfc(math.sqrt(half)), rel=1e-12)


def test_chi_square_needs_nothing_on_the_workers(spark):
    df = spark.range(1).selectExpr(chi_square_p("3D", "2"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def tail(spark, x, dof):
    df = spark.createDataFrame([(x, dof)], "x double, dof int")
    return df.selectExpr(chi_square_p("x", "dof")).first()[0]


def test_sums_keep_small_and_large_values(spark):
    df = spark.createDataFrame([(0.00004,), (0.00004,), (None,)], "x double")
    assert rows_of(df.agg(F.expr(exact_sum("x")))) == [(0.00008,)]
    df = spark.createDataFrame([(2e14,), (1e15,), (0.25,)], "x double")
    assert rows_of(df.agg(F.expr(exact_sum("x")))) == [(1.20000000000000025e15,)]


NAN, INF = float("nan"), float("inf")


def _sum_of(spark, values, kind="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [df.repartition(n).agg(F.expr(exact_sum("x"))).first()[0] for n in (1, 5)]


@pytest.mark.parametrize(
    "values",
    [
        [0.1] * 10,
        [1e20, 1.0, -1e20],
        [-0.1, None],
        [1e-5, -1e-5, 3e-20],
        [5e-324, 2.0**72, 1.5 * 2.0**71],
        [0.5] * 1001,
        [-(2.0**71), 2.0**71 - 2.0**18, 2.0**-70],
    ],
)
def test_exact_sum_is_the_rounded_sum_of_doubles(spark, values):
    exact = math.fsum(v for v in values if v is not None)
    for got in _sum_of(spark, values):
        assert abs(got - exact) <= 2 * math.ulp(exact)


def test_exact_sum_of_many_magnitudes_does_not_depend_on_order(spark):
    draw = random.Random(3)
    values = [draw.choice((-1, 1)) * 10 ** draw.uniform(-4, 17) for _ in range(2000)]
    once, again = _sum_of(spark, values)
    assert once == again == _sum_of(spark, values[::-1])[1]
    assert once == pytest.approx(math.fsum(values), rel=1e-15)


@pytest.mark.parametrize(
    "values", [[NAN, 1.0], [INF, 1.0], [-INF, 2.0, None], [INF, -INF], [None], [], [1e300, 1e300]]
)
def test_exact_sum_of_special_values_is_the_plain_sum(spark, values):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE)")
    for value in values:
        con.execute("INSERT INTO t VALUES (?)", [value])
    want = con.execute("SELECT sum(x) FROM t").fetchone()[0]
    for got in _sum_of(spark, values):
        assert repr(got) == repr(want)


def test_limbs_leave_room_for_many_rows(spark):
    limbs = [_limb("x", place) for place in _LIMB_PLACES]
    df = spark.createDataFrame([(0.5,), (-(2.0**72) * (1 - 2.0**-53),), (2.0**48 - 2.0**-4,)], "x double")
    most = max(abs(v) for row in df.selectExpr(*limbs).collect() for v in row)
    assert most <= 2**24 and most * 5 * 10**11 < 2**63


def test_exact_sum_of_decimals_stays_decimal(spark):
    df = spark.createDataFrame([(Decimal("0.10"),), (Decimal("0.25"),), (None,)], "x decimal(18,2)")
    total = df.agg(F.expr(exact_sum("x")).alias("s"))
    assert total.first()[0] == 0.35
    assert "rint" not in total._jdf.queryExecution().optimizedPlan().toString()
