"""Importance resampling against a plain loop and SQL."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
from hypothesis import given
from hypothesis import strategies as st

from stayrate.llm import oracle
from stayrate.llm import queries as Q
from stayrate.llm import resampling as R

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text, n=2):
    found = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(found[i : i + k]) for k in range(1, n + 1) for i in range(len(found) - k + 1)]
    return found, [zlib.crc32(run.encode()) for run in runs]


def plain(rows, target, percent=25, min_words=20, seed=7, n=2, buckets=10_000):
    """[(doc_id, n_words, n_features, weight, score, rank)] of (doc_id, text) rows."""
    s = Counter(f % buckets for _, text in rows for f in features(text, n)[1])
    t = Counter(f % buckets for text in target for f in features(text, n)[1])
    s_all, t_all = s.total(), t.total()
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
        for b in range(buckets)
    ]
    out = []
    for doc_id, text in rows:
        found, hashes = features(text, n)
        weight = sum(gain[f % buckets] for f in hashes) // len(hashes) if hashes else 0
        name = f"{seed}:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        digest = zlib.crc32((text or "").encode())
        out.append([doc_id, len(found), len(hashes), weight, score, None, digest])
    fit = [r for r in out if r[1] >= min_words]
    fit.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[6], r[2]))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[5] = rank
    return [tuple(r[:6]) for r in out]


def key(row):
    return tuple((v is not None, v or 0) for v in row)


@given(st.text() | st.text(st.sampled_from("aZ09 éÀ-_.\x00\n中")))
def test_hashes_of_features(text):
    found = R.words(text.encode())
    words, hashes = features(text, 3)
    assert [w.decode() for w in found] == words
    assert [h for part in R.feature_hashes(found, 3) for h in part] == hashes


def test_query_equals_plain_loop_and_sql(spark):
    got = Q.op13_importance_resampling(spark, FOLDER)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(got.columns) == sorted(columns) and {t for _, t in got.dtypes} == {"bigint"}
    rows = sorted((tuple(r) for r in got.select(columns).collect()), key=key)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = sorted(((a, c, d, e, f) for a, _, c, d, e, f in plain(docs, target)), key=key)
    assert rows == want and any(r[4] for r in rows)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    sql = oracle.oracle_sql()["op13_importance_resampling"]
    assert sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=key) == want


def test_odd_rows(spark):
    some = "Some words, of NO use: 12a3 über-all! "
    rows = [
        (None, some * 3),
        (None, None),
        (1, None),
        (2, ""),
        (3, " .,\n\x00"),
        (4, some * 5_000),
        (4, some * 4),
        (4, some * 4),
        (-5, "one"),
        *[(6 + i % 3, some * (3 + i % 2)) for i in range(40)],
    ]
    frame = spark.createDataFrame(
        [(t, i, "x", 1) for i, t in rows], "text string, doc_id int, rank string, score int"
    ).repartition(4)
    target = spark.createDataFrame([("of no use",), (None,), ("all",)], "text string")
    got = R.resample(frame, target, percent=60, min_words=8)
    want = plain(rows, ["of no use", None, "all"], percent=60, min_words=8)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    got = R.resample(frame, target, percent=100, min_words=0, n=3, buckets=7, seed=1)
    want = plain(rows, ["of no use", None, "all"], 100, 0, 1, 3, 7)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.resample(empty, empty).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    got = R.resample(one, empty, percent=100, min_words=1).collect()
    assert [tuple(r) for r in got] == plain([(1, "a b")], [], 100, 1)
    assert R.resample(empty, one).collect() == []
