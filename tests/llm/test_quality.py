"""Suffix arrays and the quality rules against plain loops."""

from __future__ import annotations

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stayrate.llm import quality as Q

FOLDER = "/root/testdata/sf0.001"
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=4))
def test_longest_repeats(texts):
    tokens = np.array([t + 10 * i for i, text in enumerate(texts) for t in text], np.uint64)
    end = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts]).astype(np.int64)
    got = Q.longest_repeats(tokens, end, 2).tolist()
    want = []
    for text in texts:
        for i in range(len(text)):
            sizes = [
                n
                for j in range(len(text))
                if j != i
                for n in range(2, len(text) + 1)
                if max(i, j) + n <= len(text) and text[i : i + n] == text[j : j + n]
            ]
            want.append(max(sizes, default=0))
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_suffix_order(text):
    tokens = np.array(text, np.uint64)
    order = Q.suffix_order(tokens, np.full(len(text), len(text)))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def judged(df, **limits):
    rows = Q.repetition_quality(df, **limits).collect()
    return [(r["doc_id"], *(r[n] for n in NAMES)) for r in rows]


def test_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = [(r["doc_id"], *brute.quality(r["text"], 10, 20, 50)) for r in df.collect()]
    assert sorted(judged(df)) == sorted(want)


def test_odd_texts(spark):
    line = "a b c d e f g h i j k l"
    texts = [
        None, "", "  \n ", "é" * 9, "x" * 5000, f"{line}\n{line}", f"{line}\n\n{line} z", "a " * 300,
        "# * $ % & | < >\n#\n#", f"{line} {line[::-1]}", "\n".join([line, " " + line, line.upper()]),
        " ".join(f"w{i % 70}" for i in range(150)),
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, line), (3, line), (3, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limits in ({}, {"min_repeat": 6, "max_covered": 5, "max_repeat": 7}):
        args = {"min_repeat": 10, "max_covered": 20, "max_repeat": 50} | limits
        want = [(i, *brute.quality(t, **args)) for i, t in rows]
        assert sorted(judged(df, **limits), key=repr) == sorted(want, key=repr)


def test_columns_are_kept(spark):
    df = spark.createDataFrame([("b", 1, "x")], "kept string, n_words int, text string")
    got = Q.with_quality(df, "quality")
    assert got.columns == ["kept", "n_words", "text", "quality"]
    assert got.select("kept", "n_words", "text").first() == ("b", 1, "x")
    assert Q.repetition_quality(df.selectExpr("1L AS doc_id", "text").limit(0)).collect() == []


def test_patterned_lines_and_words_are_not_repeats(spark):
    x, y = brute.thue_morse(2048), brute.thue_morse(2048, "b", "a")
    rows = [(1, f"{x}\n{y}"), (2, f"{x}\n{y}\n{x}"), (3, " ".join(x) + " c " + " ".join(y))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in Q.repetition_quality(frame).collect()}
    assert [got[i].n_dup_lines for i in (1, 2)] == [0, 1]
    words = rows[2][1].split()
    longest = max(
        n
        for n in (1024, 1025, 1536, 2047, 2048)
        if len({tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) < len(words) - n + 1
    )
    assert longest <= got[3].longest_repeat < 2048
