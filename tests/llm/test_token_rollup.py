"""Rollups: additive totals, replays, writers that die, snapshots."""

from __future__ import annotations

import base64
from collections import Counter

import pytest
import tiktoken

from stayrate.llm import token_rollup as R
from stayrate.llm.queries import BPE_RANKS

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "source string, lang string, n long, m long"


def totals(rollup):
    return {tuple(r[k] for k in R.KEYS): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


@pytest.fixture
def rollup(spark, tmp_path):
    return R.Rollup(spark, f"file://{tmp_path}/rollup")


def test_batches_add_up(spark, rollup):
    assert totals(rollup) == {}
    docs = spark.createDataFrame(
        [("a", "en", 5, 6), ("a", "en", 7, 7), (None, "en", 1, 1), ("a", None, 0, 0)], SCHEMA
    )
    assert rollup.commit("load", R.inserted(docs, "t'1", "n"))
    want = {("a", "en", "t'1"): (2, 12), (None, "en", "t'1"): (1, 1), ("a", None, "t'1"): (1, 0)}
    assert totals(rollup) == want
    assert not rollup.commit("load", R.inserted(docs, "t'1", "n"))
    assert totals(rollup) == want
    rollup.commit("revise", R.revised(docs, "t'1", "n", "m"))
    want["a", "en", "t'1"] = (2, 13)
    assert totals(rollup) == want
    rollup.compact()
    rollup.commit("drop", R.deleted(docs.filter("lang = 'en' AND source IS NULL"), "t'1", "m"))
    del want[None, "en", "t'1"]
    assert totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want
    rollup.commit("empty", R.inserted(docs.limit(0), "t'1", "n"))
    assert totals(rollup) == want


def test_a_batch_without_marker_does_not_count(spark, rollup):
    docs = spark.createDataFrame([("a", "en", 5, 6)], SCHEMA)
    R.inserted(docs, "t", "n").write.parquet(f"{rollup.folder}/batches/half")
    assert totals(rollup) == {}
    assert rollup.commit("half", R.inserted(docs, "t", "n"))
    assert totals(rollup) == {("a", "en", "t"): (1, 5)}


def test_wrong_batches(spark, rollup):
    docs = spark.createDataFrame([("a", "en", None, 6)], SCHEMA)
    with pytest.raises(Exception, match="incomplete change"):
        rollup.commit("bad", R.inserted(docs, "t", "n"))
    with pytest.raises(ValueError, match="batch id"):
        rollup.commit("../x", R.inserted(docs, "t", "m"))
    assert rollup.committed() == []


def test_bpe_counts(spark):
    import base64

    import tiktoken

    with open(BPE_RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    tool = tiktoken.Encoding("t", pat_str=R.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "é <|endoftext|> \n")], docs.schema)
    rows = docs.union(odd).collect()
    got = R.with_bpe(R.with_words(docs.union(odd), "words"), "bpe", BPE_RANKS).collect()
    assert Counter((r["doc_id"], r["bpe"]) for r in got) == Counter(
        (r["doc_id"], len(tool.encode_ordinary(r["text"] or ""))) for r in rows
    )
    assert {r["words"] for r in got if r["doc_id"] in (None, -1)} == {0}


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_RANKS, "rb"))}
    return tiktoken.Encoding("bpe", pat_str=R.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("run", [" " * 1000, "\n" * 1500, " \t\n\u3000" * 400, " " * 999 + "\x1f" + " " * 2000])
def test_cut_runs_give_the_same_tokens(encoding, run):
    for text in (run, f"a{run}", f"{run}b", f"a.{run}b 's{run}", f"1{run}'s{run}\u00e9 {run} x"):
        assert R.n_tokens(encoding, text) == len(encoding.encode_ordinary(text))


def test_a_run_of_two_million_spaces(spark):
    text = "a" + " " * 2_000_000 + "b"
    df = spark.createDataFrame([(text, 1), ("a b", 2), (None, 3)], "text string, id int")
    got = {r.id: r.n for r in R.with_bpe(df, "n", BPE_RANKS).collect()}
    assert got == {1: 2_000_001, 2: 2, 3: 0}  # the vocabulary has no longer run of spaces


def test_second_writer_that_dies_leaves_the_batch(spark, rollup):
    docs = spark.createDataFrame([("a", "en", 5, 6)], SCHEMA)
    late = R.Rollup(spark, rollup.folder)
    store = late._store

    class Slow:  # sees no marker, as it looked before the first writer set it
        def __getattr__(self, name):
            return getattr(store, name)

        def exists(self, path):
            return False

    late._store = Slow()
    assert rollup.commit("b", R.inserted(docs, "t", "n"))
    dying = docs.selectExpr("source", "lang", "raise_error('lost') AS n")
    with pytest.raises(Exception, match="lost"):
        late.commit("b", R.inserted(dying, "t", "n"))
    assert totals(rollup) == {("a", "en", "t"): (1, 5)}
    assert not late.commit("b", R.inserted(docs, "t", "m"))
    assert totals(rollup) == {("a", "en", "t"): (1, 5)}
