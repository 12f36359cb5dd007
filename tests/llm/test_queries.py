"""Registered queries: against SQL where there is some, and by their own rules elsewhere."""

from __future__ import annotations

import random

import brute
import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from stayrate.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
SQL = queries.oracle_sql()


def texts_of(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_all_are_registered():
    names = [n for n in driver.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in driver.queries() and "pipeline" not in driver.oracle_sql()
    assert set(SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = driver.queries()[name](spark, FOLDER)
    expected = con.execute(SQL[name])
    columns = {d[0]: str(d[1]) for d in expected.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == columns
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert rows == sorted(expected.fetchall(), key=repr)


def test_substring_dedup_query(spark):
    got = queries.op10_substring_dedup(spark, FOLDER).collect()
    want = brute.line_dedup(texts_of(spark), 8)
    assert {r["doc_id"]: (r["text"], r["n_units"], r["starts"], r["ends"]) for r in got} == want


def test_suffix_dedup_query(spark):
    got = queries.op9_suffix_dedup(spark, FOLDER).collect()
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got} == brute.suffix_dedup(
        texts_of(spark), 100
    )


def test_token_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    first = {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r)
    want = {}
    for r in first.values():
        n, tokens = want.get((r["source"], r["lang"]), (0, 0))
        want[r["source"], r["lang"]] = (n + 1, tokens + len(brute.words(r["text"])))
    got = queries.op8_token_counts(spark, FOLDER).collect()
    words = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in got if r["tokenizer"] == "words/1"}
    assert words == want
    assert {(r["source"], r["lang"]) for r in got if r["tokenizer"] != "words/1"} == set(want)


def brute_pipeline(texts, items):
    kept = {i: t for i, t in texts.items() if brute.quality(t, 10, 20, 50)[-1]}
    groups = brute.components(kept, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    kept = {i: row[0] for i, row in brute.line_dedup(kept, 8).items()}
    kept = {i: t for i, t in kept.items() if brute.words(t)}
    clean = {}
    for i, t in kept.items():
        words = brute.WORD.findall(brute.lowered(t.encode()))
        if all(brute.edit_distance(w, words) > int(0.2 * len(w)) for w in items):
            clean[i] = len(brute.words(t))
    return clean


def test_pipeline(spark):
    items = [
        brute.WORD.findall(brute.lowered(r["text"].encode()))
        for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    ]
    want = brute_pipeline(texts_of(spark), items)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["bucket"] >= r["n_tokens"] for r in got)
    assert len({r["bucket"] for r in got}) <= packing.BUCKETS


ODD = [
    (None, "a b c d e f g h i j k l m n", 1),
    (7, "a b c d e f g h i j k l m n", 2),
    (7, "a b c d e f g h i j k l m n", 2),
    (8, None, 3),
    (9, "", 4),
    (10, "o p q r s t u v w x y z 1 2 3\na b c d e f g h i j k l m n", 5),
    (11, "word " * 30_000, 6),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, n_chars int, hits string, removal int, quality int, kept int"
    df = spark.createDataFrame([(i, t, k, "h", k, k, k) for i, t, k in ODD], schema)
    out = stage(spark, df, FOLDER)
    rows = out.collect()
    if name != "packing":
        assert out.columns == df.columns
        assert all(r["hits"] == "h" for r in rows)
    ids = [r["doc_id"] for r in rows]
    assert {"quality": 4, "near_duplicates": 6, "repeated_passages": 5, "decontamination": 7,
            "packing": 7}[name] == len(ids)
    assert stage(spark, df.limit(0), FOLDER).collect() == []


def test_near_duplicates_link_at_80_percent_of_five_words(spark):
    rng = random.Random(9)
    texts = {}
    for i in range(0, 60, 2):
        words = [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(40, 90))]
        more = [f"x{rng.randrange(10_000)}" for _ in range(int(len(words) * rng.uniform(0.1, 0.3)))]
        texts[i], texts[i + 1] = " ".join(words), " ".join(words + more)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, FOLDER).collect()}
    assert kept == {i for i, (_, c) in brute.components(texts, 5, 80).items() if c == i}
    assert len(kept) < len({c for _, c in brute.components(texts).values()})
