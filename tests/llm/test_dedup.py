"""Suffix-array dedup and line dedup against plain loops."""

from __future__ import annotations

import random

import brute
import pytest

from stayrate.llm.line_dedup import dedup_units
from stayrate.llm.suffix_dedup import remove_repeats

FOLDER = "/root/testdata/sf0.001"
NAMES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.fixture(scope="module")
def patched():
    """Texts of few letters, so that strings repeat inside and across them at all offsets."""
    rng = random.Random(8)
    parts = ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 40))) for _ in range(25)]
    texts: list[str | None] = [
        "".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(80)
    ]
    texts += [None, "", "a", "a" * 100, "a" * 5, "ab" * 60]
    texts += texts[:10]
    return dict(enumerate(texts))


def removed(df, **options):
    rows = remove_repeats(df, **options).collect()
    return {r["doc_id"]: tuple(r[n] for n in NAMES) for r in rows}


@pytest.mark.parametrize("length", [1, 2, 7, 12])
def test_suffix_dedup_of_short_strings(spark, patched, length):
    df = spark.createDataFrame(list(patched.items()), "doc_id long, text string").repartition(3)
    assert removed(df, length=length) == brute.suffix_dedup(patched, length)


def test_suffix_dedup_in_small_pieces(spark, patched, monkeypatch):
    monkeypatch.setattr("stayrate.llm.suffix_dedup._PIECE", 64)
    monkeypatch.setattr("stayrate.llm.suffix_dedup.WINDOWS_PER_PASS", 100)
    df = spark.createDataFrame(list(patched.items()), "doc_id long, text string").repartition(3)
    assert removed(df, length=9) == brute.suffix_dedup(patched, 9)


def test_suffix_dedup_of_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert removed(df) == brute.suffix_dedup(texts, 100)


def test_suffix_dedup_offsets(spark):
    df = spark.createDataFrame([(1, "xabcdefy"), (2, "abcdef-é-abcdef")], "doc_id long, text string")
    row = remove_repeats(df, length=5).filter("doc_id = 2").first()
    assert (row["starts"], row["ends"]) == ([0, 10], [6, 16])


def test_suffix_dedup_of_repeated_and_missing_ids(spark):
    rows = [
        (1, "abcdefgh", 1.0),
        (1, "abcdefgh", 2.0),
        (2, "--abcdefgh", 3.0),
        (None, "abcdefgh", 4.0),
        (3, "qrstuv", 5.0),
        (3, "abcdef", 6.0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes double")
    got = sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in remove_repeats(df, length=5).collect()),
        key=repr,
    )
    # Of the two texts of document 3 the one with the smaller digest takes part: "qrstuv".
    chosen = min(("qrstuv", "abcdef"), key=lambda t: brute.hashlib.sha256(t.encode()).hexdigest())
    lost = 6 if chosen == "abcdef" else 0
    assert got == sorted(
        [(1, 8, 0), (1, 8, 0), (2, 10, 8), (None, 8, 0), (3, 6, 0), (3, 6, lost)], key=repr
    )


def cleaned(df, **options):
    rows = dedup_units(df, **options).collect()
    return {
        r["doc_id"]: (r["text"], r["removal"]["n_units"], r["removal"]["starts"], r["removal"]["ends"])
        for r in rows
    }


def test_line_dedup_of_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert cleaned(df) == brute.line_dedup(texts, 8)


@pytest.mark.parametrize("min_words", [1, 3, 6])
def test_line_dedup_of_short_lines(spark, min_words):
    rng = random.Random(4)
    lines = ["A b c", "a  B\tc", "one. two! three?", "é È", "", "x y z w.", "k", " \x0b"]
    texts = {
        i: rng.choice(["\n", " ", "\n\n"]).join(rng.choices(lines, k=rng.randint(0, 6)))
        for i in range(60)
    } | {60: None, 61: "", 62: "\n\n"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert cleaned(df, min_words=min_words) == brute.line_dedup(texts, min_words)


def test_a_passage_inside_lines_is_found(spark):
    passage = "It was so. The cat sat on the mat. Then it went out of the house."
    texts = {1: f"Begin {passage} And more here.\nLast", 2: f"Other words: {passage} The end."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert cleaned(df) == brute.line_dedup(texts, 8)
    assert "cat" not in cleaned(df)[2][0] and "The end." in cleaned(df)[2][0]


def test_patterns_are_not_taken_for_repeats(spark):
    x, y = brute.thue_morse(2048), brute.thue_morse(2048, "b", "a")
    tail = " one two three four five six seven eight"
    texts = {1: x + tail, 2: y + tail, 3: x + tail}
    texts |= {4: " ".join(x) + ".", 5: " ".join(y) + ".", 6: " ".join(x) + "."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert cleaned(df) == brute.line_dedup(texts, 8)
    assert cleaned(df)[2][0] == texts[2] and cleaned(df)[5][0] == texts[5]


def test_short_repeats_are_reported(spark):
    texts = {1: "A short line.\nOne of nine words that is long enough, yes.", 2: "A short line.\nOther."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.text, r.removal) for r in dedup_units(df).collect()}
    assert found[2][0] == texts[2] and found[2][1].n_removed == 0
    assert (found[2][1].short_starts, found[2][1].short_ends) == ([0], [14])
    assert (found[1][1].short_starts, found[1][1].starts) == ([], [])
    removed = {r.doc_id: r.removal for r in dedup_units(df, min_words=1).collect()}
    assert (removed[2].starts, removed[2].ends, removed[2].short_starts) == ([0], [14], [])


def test_line_dedup_keeps_columns_and_odd_rows(spark):
    line = "one two three four five six seven eight nine"
    rows = [(1, line, 1), (2, line, 2), (None, line, 3), (4, line, 4), (4, line, 5), (5, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = dedup_units(df)
    assert got.columns == ["doc_id", "text", "id", "removal"]
    assert {(r["id"], r["text"]) for r in got.collect()} == {
        (1, line), (2, ""), (3, line), (4, line), (5, line), (6, None),
    }


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).collect() == []
    assert dedup_units(df).collect() == []
