"""Token files: coding round trips, pieces against whole texts, files against a plain loop."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stayrate.llm import queries as Q
from stayrate.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70_000), max_size=9), max_size=6))
def test_coding_round_trip(documents):
    ids = np.array([len(d) for d in documents], np.int64)
    ranks = np.array([x for d in documents for x in d], np.uint32)
    control, data = T.encode(ranks, ids)
    assert len(control) == T.control_bytes(ids).sum()
    assert T.decode(control, data, ids).tolist() == ranks.tolist()


def test_length_of_coded_ranks():
    control, data = T.encode(np.array([255, 256, 65535, 65536, 1 << 24]), np.array([5]))
    assert control.tolist() == [0b10_01_01_00, 0b11]
    assert len(data) == 1 + 2 + 2 + 3 + 4


ODD = "aA.b, ;!?'sSé×̸̱́<|>= \u0085 \x0b\x0c\x1c\t\n İΣ中1퟿\U0001f600"
WORDS = ["don't", "HE'LL.", "a.b", "Été.", "<|endoftext|>", "<|STARTOFTEXT|>", "H̱.", " "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(ODD, max_size=6) | st.sampled_from(WORDS), max_size=12).map("".join))
def test_pieces_equal_whole_texts(tokenizer, text):
    ids, counts = T.pieces_of(PATH).encode(pa.array([text, "one", "", text]))
    whole = tokenizer.encode(text, add_special_tokens=False).ids
    one = tokenizer.encode("one", add_special_tokens=False).ids
    assert ids.tolist() == [*whole, *one, *whole]
    assert counts.tolist() == [len(whole), len(one), 0, len(whole)]


def test_pieces_are_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(T, "PIECES_KEPT", 3)
    pieces = T.Pieces(PATH)
    for text in ("one two three four five", "one six", "two seven two", "eight"):
        ids, _ = pieces.encode(pa.array([text]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(pieces.number) < 8


def test_tokenizers_that_keep_white_space_are_refused():
    with pytest.raises(ValueError, match="white space"):
        T.Pieces(public_tokenizers.path("byte_bpe_50k.json"))


def test_slices_hold_all_texts(monkeypatch):
    monkeypatch.setattr(T, "SLICE_BYTES", 4)
    texts = pa.array(["a", None, "bcdefgh", "", "ij", "k"])
    assert [t for part in T.slices(texts) for t in part.to_pylist()] == ["a", "", "bcdefgh", "", "ij", "k"]
    assert list(T.slices(pa.array([], pa.string()))) == []


def plain(tokenizer, rows):
    """{(doc_id, start): (n_tokens, crc)} of (doc_id, text) rows in the order of the files."""
    out, start = {}, 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc_id, start] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def found(df):
    rows = df.collect()
    out = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_plain_loop(spark, tokenizer):
    got = Q.op11_token_files(spark, FOLDER)
    assert got.dtypes == [
        ("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")
    ]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert found(got) == plain(tokenizer, sorted(docs))


def test_odd_rows(spark, tmp_path, tokenizer):
    long = "Longer, and longer. " * 60_000 + "x" * 5_000
    rows = [
        (7, "seven", 1),
        (None, "no id", 2),
        (-3, None, 3),
        (5, "", 4),
        (6, long, 5),
        (4, " \n\t", 6),
        (7, "seven", 7),
        (7, "other seven", 8),
    ]
    frame = spark.createDataFrame(rows, "doc_id int, text string, start int").repartition(3)
    frame.createTempView("odd_tokens")
    manifest = T.token_files(frame, PATH, 2, folder=f"file://{tmp_path}/files", )
    got = {}
    for r in T.read_files(manifest).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.n_tokens and ids[-1] == 2
        got[r.start] = (r.doc_id, ids.tolist())
    order = [None, -3, 4, 5, 6, 7, 7, 7]
    assert [got[s][0] for s in sorted(got)] == order
    want = sorted([*tokenizer.encode(t or "").ids, 2] for _, t, _ in rows)
    assert sorted(ids for _, ids in got.values()) == want
    starts = np.cumsum([0] + [len(got[s][1]) for s in sorted(got)])
    assert sorted(got) == starts[:-1].tolist()
    assert sum(r.documents for r in manifest.collect()) == len(rows)


def test_small_blocks_and_files(spark, tmp_path, tokenizer, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 16)
    rows = [(i, "word " * (i % 11) + "end.") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    manifest = T.token_files(frame, PATH, 2, folder=f"file://{tmp_path}/small")
    got = sorted(T.read_files(manifest).selectExpr("start", "doc_id", "crc32(ids)").collect())
    want = plain(tokenizer, rows)
    assert [(d, s) for s, d, _ in got] == list(want)
    assert [c for *_, c in got] == [c for _, c in want.values()]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert T.read_files(T.token_files(empty, PATH, 2)).collect() == []


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.tokens").write_bytes(b"something else")
    manifest = spark.createDataFrame(
        [(0, f"file://{tmp_path}/x.tokens", 1, 1)], "shard bigint, file string, documents bigint, ids bigint"
    )
    with pytest.raises(Exception, match="no token file"):
        T.read_files(manifest).collect()
