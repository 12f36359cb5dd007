"""Leaks: exact and edited items are found, other texts are left alone."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from stayrate.llm import decontaminate as D

FOLDER = "/root/testdata/sf0.001"


def phrase(rng, n):
    return [f"w{rng.randint(0, 300)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        spot = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[spot] = "zz"
        elif kind == 1:
            words.insert(spot, "zz")
        else:
            del words[spot]
    return words


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    items = {i: phrase(rng, rng.randint(6, 70)) for i in range(40)}
    docs, truth = {}, {}
    for doc in range(200):
        words = phrase(rng, rng.randint(0, 120))
        if doc % 2:
            item = rng.randrange(40)
            edits = [0, 0, 1, 2][doc // 2 % 4]
            edits = min(edits, int(0.2 * len(items[item])) // 2)
            spot = rng.randint(0, len(words))
            words[spot:spot] = edited(rng, items[item], edits)
            truth[doc] = (item, edits)
        docs[doc] = " ".join(words)
    return {i: " ".join(w) for i, w in items.items()}, docs, truth


def frames(spark, items, docs):
    return (
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
    )


def test_planted_items(spark, planted):
    items, docs, truth = planted
    found = D.find_leaks(*frames(spark, items, docs)).collect()
    hits = {(r["doc_id"], h["item_id"]): h for r in found for h in r["hits"]}
    exact = {(d, i) for d, (i, edits) in truth.items() if edits == 0}
    close = {(d, i) for d, (i, edits) in truth.items() if edits}
    assert exact <= set(hits) and all(hits[k]["edits"] == 0 for k in exact)
    assert len(close & set(hits)) >= 0.9 * len(close)
    # Every hit is within the limit, and its range holds the item.
    for (doc, item), hit in hits.items():
        wanted = items[item].split()
        stretch = docs[doc].encode()[hit["start"] : hit["end"]].decode().split()
        assert brute.edit_distance(wanted, stretch) == hit["edits"] <= 0.2 * len(wanted)
        assert brute.edit_distance(wanted, docs[doc].split()) <= hit["edits"]
    # Recall over all pairs that brute force finds.
    near = {
        (d, i)
        for d, t in docs.items()
        for i, w in items.items()
        if brute.edit_distance(w.split(), t.split()) <= int(0.2 * len(w.split()))
    }
    assert set(hits) <= near and len(hits) >= 0.9 * len(near)


def test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = {r["item_id"]: brute.words(r["text"].lower()) for r in benchmark.collect()}
    found = {
        (r["doc_id"], h["item_id"]): h["edits"]
        for r in D.find_leaks(docs, benchmark).collect()
        for h in r["hits"]
    }
    for r in docs.collect():
        words = brute.words(r["text"].lower())
        for item, wanted in items.items():
            inside = any(words[i : i + len(wanted)] == wanted for i in range(len(words)))
            assert inside == (found.get((r["doc_id"], item)) == 0)


def test_short_items_are_found_with_all_their_edits(spark):
    rng = random.Random(6)
    items = {i: phrase(rng, 1 + i % 15) for i in range(60)}
    docs = {}
    for doc in range(300):
        words = phrase(rng, rng.randint(0, 40))
        item = items[doc % 60]
        spot = rng.randint(0, len(words))
        words[spot:spot] = edited(rng, item, int(0.2 * len(item)))
        docs[doc] = " ".join(words)
    texts = {i: " ".join(w) for i, w in items.items()}
    found = D.find_leaks(*frames(spark, texts, docs)).collect()
    hits = {(r["doc_id"], h["item_id"], h["edits"]) for r in found for h in r["hits"]}
    want = {
        (d, i, edits)
        for d, t in docs.items()
        for i, w in items.items()
        if (edits := brute.edit_distance(w, t.split())) <= int(0.2 * len(w))
    }
    assert len(want) >= 300 and hits == want


@pytest.mark.parametrize("sizes", [(15, 59), (16, 70)])
def test_a_class_that_misses_the_recall_is_exact(spark, monkeypatch, sizes):
    monkeypatch.setattr(D, "MOST_REPETITIONS", 0)
    monkeypatch.setattr(D, "SEED_PAIRS", 200)
    rng = random.Random(8)
    items = {i: phrase(rng, rng.randint(*sizes)) for i in range(20)}
    docs = {
        d: " ".join(phrase(rng, 20) + edited(rng, items[d], int(0.2 * len(items[d]))) + phrase(rng, 9))
        for d in items
    }
    texts = {i: " ".join(w) for i, w in items.items()}
    found = D.find_leaks(*frames(spark, texts, docs)).collect()
    assert all(r["doc_id"] in [h["item_id"] for h in r["hits"]] for r in found)


def test_recall_by_class_of_lengths():
    rng = np.random.default_rng(3)
    tokens = [rng.integers(1, 2**63, n, np.uint64) for n in [*[16] * 5, *[60] * 200]]
    index = D.index_of(list(range(len(tokens))), tokens, 0.2, 0.95)
    hits = []
    for i in [*range(5)] * 40:
        text = D.mutated(tokens[i], int(0.2 * len(tokens[i])), rng)
        end = np.full(len(text), len(text))
        hits.append(any(i in item for _, item, _ in D.candidates(index, text, end)))
    assert np.mean(hits) >= 0.9


def test_blocks_of_the_benchmark(spark, planted, monkeypatch):
    items, docs, _ = planted
    whole = D.find_leaks(*frames(spark, items, docs)).selectExpr("doc_id", "inline(hits)")
    monkeypatch.setattr(D, "BLOCK_BYTES", 2500)
    monkeypatch.setattr(D, "repetitions_for", lambda *a: 3)
    parts = D.find_leaks(*frames(spark, items, docs)).selectExpr("doc_id", "inline(hits)")
    exact = "edits = 0"
    assert {tuple(r) for r in whole.filter(exact).collect()} == {
        tuple(r) for r in parts.filter(exact).collect()
    }


def test_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog"
    docs = [
        (1, None, "a"), (2, "", "b"), (None, f"so {item.upper()}", "c"), (3, item, "d"), (3, item, "d"),
        (4, "the quick", "e"), (5, "x " * 20_000 + item, "f"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, hits string")
    items = [(7, item), (7, item), (None, item), (8, None), (9, "too short"), (10, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_leaks(df, benchmark, to="leaks")
    assert got.columns == ["doc_id", "text", "hits", "leaks"]
    found = {r["hits"]: [(h["item_id"], h["edits"]) for h in r["leaks"]] for r in got.collect()}
    three = [(7, 0), (7, 0), (None, 0)]
    assert found == {"a": [], "b": [], "c": three, "d": three, "e": [], "f": three}
    assert D.find_leaks(df, benchmark).columns == ["doc_id", "text", "hits"]
    assert D.find_leaks(df.limit(0), benchmark).collect() == []
    none = D.find_leaks(df, benchmark.limit(0))
    assert none.count() == len(docs) and none.filter("size(hits) > 0").count() == 0


def test_alignment_is_the_edit_distance():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item = rng.integers(0, 4, rng.integers(1, 9))
        text = rng.integers(0, 4, rng.integers(0, 14))
        edits, end = D.best_edits(item, text)
        assert edits == brute.edit_distance(item.tolist(), text.tolist())
        assert brute.edit_distance(item.tolist(), text[:end].tolist()) == edits


def test_steps_of_the_embedding_stay_in_the_window():
    for band in (4, 8, 64):
        for repetition in range(5):
            steps = D.samples(repetition, band)
            assert 0 < steps[0] and steps[-1] < band and len(set(steps.tolist())) == len(steps)
