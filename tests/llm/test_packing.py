"""Bucket boundaries against all choices, and the batches made with them."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stayrate.llm import packing as P

FOLDER = "/root/testdata/sf0.001"


def padding(lengths, counts, edges):
    return sum(c * (min(e for e in edges if e >= n) - n) for n, c in zip(lengths, counts))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[n] for n in lengths]
    edges = P.boundaries(np.array(lengths), np.array(counts), buckets)
    assert edges == sorted(set(edges)) and len(edges) <= buckets and edges[-1] == lengths[-1]
    least = min(
        padding(lengths, counts, [*inner, lengths[-1]])
        for k in range(buckets)
        for inner in combinations(lengths[:-1], min(k, len(lengths) - 1))
    )
    assert padding(lengths, counts, edges) == least


def test_rounding_of_lengths(spark):
    df = spark.range(1, 200_000).selectExpr("id", f"{P.rounded('id')} AS r")
    bad = df.filter(f"r < id OR r > id * (1 + 1 / {P.EXACT}) + 1 OR (id <= {P.EXACT} AND r <> id)")
    assert bad.count() == 0
    assert df.select("r").distinct().count() < P.EXACT * 12


def check(rows, buckets, budget):
    batches = defaultdict(list)
    for r in rows:
        if r["n_tokens"] == 0:
            assert r["bucket"] is None and r["batch"] is None and r["padding"] is None
            continue
        assert r["n_tokens"] <= r["bucket"] and r["padding"] == r["bucket"] - r["n_tokens"]
        batches[r["bucket"], r["batch"]].append(r)
    edges = sorted({b for b, _ in batches})
    assert len(edges) <= buckets
    for r in rows:
        if r["n_tokens"]:
            assert r["bucket"] == min(e for e in edges if e >= r["n_tokens"])
    for edge in edges:
        mine = {k: v for (b, k), v in batches.items() if b == edge}
        fit = max(1, budget // edge)
        assert sorted(mine) == list(range(len(mine)))
        sizes = [len(mine[k]) for k in sorted(mine)]
        assert all(s == fit for s in sizes[:-1]) and 1 <= sizes[-1] <= fit
        assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in mine.values())


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL_ROWS", 7)
    monkeypatch.setattr(P, "CELLS_PER_GROUP", 3)
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = P.pack_batches(df, buckets=4, budget=3000).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {
        i: len(brute.words(t)) for i, t in texts.items()
    }
    check(rows, 4, 3000)
    again = P.pack_batches(df.repartition(5), buckets=4, budget=3000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_odd_rows(spark):
    rows = [(i, "a b", 1) for i in range(30)] + [(1, "a b", 1), (None, "c", 2), (None, None, 3)]
    rows += [(40, "", 4), (41, "x " * 5000, 5), (42, "é", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash int")
    got = P.pack_batches(df, buckets=2, budget=10)
    assert got.columns == ["doc_id", "hash", "n_tokens", "bucket", "batch", "slot", "padding"]
    found = got.collect()
    assert len(found) == len(rows)
    check(found, 2, 10)
    assert P.pack_batches(df.limit(0)).collect() == []
    assert P.pack_batches(df.selectExpr("doc_id", "cast(null as string) AS text")).count() == len(rows)


def test_boundaries_are_lengths_of_texts(spark):
    sizes = [20_001, 20_000, 19_990, 5_003, 1_025, 3]
    df = spark.createDataFrame([(n,) for n in sizes], "doc_id long")
    df = df.selectExpr("doc_id", "repeat('w ', CAST(doc_id AS INT)) AS text")
    rows = P.pack_batches(df, buckets=3).collect()
    check(rows, 3, P.BUDGET)
    assert {r["bucket"] for r in rows} <= set(sizes)
    # 19,990 to 20,001 share one entry of the histogram
    assert sum(r["padding"] for r in rows) == 12 + 1025 - 3
    (one,) = P.pack_batches(df.filter("doc_id = 20001")).collect()
    assert (one["bucket"], one["padding"]) == (20_001, 0)


def test_rows_without_id_fill_several_cells(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL_ROWS", 10)
    df = spark.range(400).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('a', id) AS text")
    rows = P.pack_batches(df, buckets=1, budget=7).collect()
    check(rows, 1, 7)


def test_own_length(spark):
    df = spark.createDataFrame([(1, "x", 7), (2, "y", 9)], "doc_id long, text string, n int")
    assert {r["n_tokens"] for r in P.pack_batches(df, length="n * 2").collect()} == {14, 18}
