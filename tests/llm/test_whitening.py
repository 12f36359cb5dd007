"""Whitening: the polar splitting against LAPACK, the query against a plain computation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stayrate.llm import queries as Q
from stayrate.llm import whitening as W

FOLDER = "/root/testdata/sf0.001"


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1e-9, 0.5, 1, 1 + 1e-7, 2, 3, 40, 1e6]), min_size=1, max_size=9))
def test_components_are_eigenvectors(values):
    a = symmetric(values, len(values))
    a = (a + a.T) / 2
    e, x = W.components(a, len(a))
    size = np.linalg.norm(a) + 1e-300
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1], rtol=0, atol=1e-13 * size)
    assert np.abs(a @ x - x * e).max() <= 1e-13 * size
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-12


def test_wanted_components_come_first():
    a = symmetric(range(1, 41))
    e, x = W.components(a, 4)
    assert np.allclose(e, [40, 39, 38, 37]) and x.shape == (40, 4)


def test_polar_factor():
    a = symmetric([-3, -1e-8, 1e-8, 2, 500])
    u = W.polar(a)
    assert np.allclose(u @ u, np.eye(5), atol=1e-12)
    e, q = np.linalg.eigh(a)
    assert np.allclose(u, (q * np.sign(e)) @ q.T, atol=1e-6)


@settings(deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(-200, 200), max_size=5))
def test_packed_vectors(values):
    x = np.array(values, np.int64)
    content = W.pack_vector(x)
    assert np.frombuffer(content, f"<i{content[0]}", len(x), 1).tolist() == values


def plain(rows, most=4):
    """{(vec_id, component): ...} by LAPACK on the distinct vectors of (vec_id, vector) rows."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d), default=0)
    good = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in good if len(v) == dims]
    fit = sorted({x for _, x in good})
    n, total = len(fit), [sum(x[d] for x in fit) for d in range(dims)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, total)] for x in fit]).reshape(n, dims)
    e, q = np.linalg.eigh(centred.T @ centred / max(n, 1))
    e, q = e[::-1], q[:, ::-1]
    keep = [k for k in range(min(most, dims)) if e[k] > dims * 2.3e-16 * e[0]]
    out = []
    for i, x in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, total))
        white = [(n * c - s) / n for c, s in zip(x, total)] @ q
        for k in keep:
            out.append((i, k + 1, n, deviation, white[k] / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def same(got, want):
    got, want = (sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))) for rows in (got, want))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a = np.array([r[4] for r in got if r[1] == k])
        b = np.array([r[4] for r in want if r[1] == k])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=0)
    assert all(0 <= r[6] < 1e-9 for r in got) and len({r[6] for r in got}) <= 1


def test_query_equals_plain_computation(spark):
    got = Q.op12_embedding_whitening(spark, FOLDER)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    table = pq.read_table(f"{FOLDER}/embeddings.parquet", columns=["vec_id", "embedding"])
    rows = list(zip(*(c.to_pylist() for c in table.columns)))
    same([tuple(r) for r in got.collect()], plain(rows))


NAN, INF = float("nan"), float("inf")
PLAIN = [(i, [math.sin(i), math.cos(3 * i), i / 7, -0.0]) for i in range(12)]
ODD = [
    (None, [1.0, 2.0, 3.0, 4.0]),
    (1, None),
    (2, []),
    (3, [1.0, None, 0.0, 0.0]),
    (4, [NAN, 1.0, 0.0, 0.0]),
    (5, [1.0, -INF, 0.0, 0.0]),
    (6, [1.0, 2.0]),
    *[(7, [0.5, 0.5, 0.5, 0.5])] * 50,
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows(spark, kind):
    rows = [(v, i, 0) for i, v in PLAIN + ODD]
    frame = spark.createDataFrame(rows, f"embedding array<{kind}>, vec_id int, component int")
    got = W.whiten(frame.repartition(5)).collect()
    if kind == "float":
        rows = [(v and [c if c is None else float(np.float32(c)) for c in v], i, 0) for v, i, _ in rows]
    same([tuple(r) for r in got], plain([(i, v) for v, i, _ in rows]))


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None)],
        [(1, [])],
        [(1, [1.0, 2.0])],
        [(1, [1.0, 2.0]), (2, [1.0, 2.0])],
    ],
)
def test_nothing_to_whiten(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert W.whiten(frame).collect() == []


def test_low_rank_and_huge_entries(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    same([tuple(r) for r in W.whiten(frame).collect()], plain(rows))
    rows = [(i, [1e300 * (i % 2), float(i), -1e17 * (i % 3)]) for i in range(9)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = W.whiten(frame, 2).collect()
    assert len(got) == 18 and all(r.deviation is None and math.isfinite(r.whitened) for r in got)
    assert all(r.identity_error < 1e-9 for r in got)


def test_exact_products_of_long_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**40), 2**40, (50, 3))
    frame = spark.createDataFrame([(bytearray(W.pack_vector(v)),) for v in x], "x binary").repartition(4)
    n, sums = W.column_sums(frame, 3)
    assert (n, sums) == (50, x.astype(object).sum(axis=0).tolist())
    centre = [s // n for s in sums]
    y = x.astype(object) - np.array(centre, object)
    assert np.triu(W.centred_products(frame, centre)).tolist() == np.triu(y.T.dot(y)).tolist()
