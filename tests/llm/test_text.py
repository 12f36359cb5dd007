"""Words, shingles and fingerprints against regular expressions."""

from __future__ import annotations

import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stayrate.llm import text as T

TEXTS = st.lists(
    st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1f\x85A.", max_size=30)), max_size=8
)


def every_slice(column, max_bytes):
    return list(T.text_slices(pa.array(column, pa.string()), max_bytes))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 5, 1000]))
def test_words_and_sets(texts, max_bytes):
    found = []
    for part in every_slice(texts, max_bytes):
        words = T.words(part)
        for row in range(part.last - part.first):
            here = words.text == row
            spans = zip(words.start[here], words.end[here])
            found.append([part.data[a:b].tobytes() for a, b in spans])
    assert found == [brute.words(t) for t in texts]
    sizes = [
        len(s) for part in every_slice(texts, max_bytes) for s in T.shingle_sets(part, 3)
    ]
    assert sizes == [len(brute.shingles(t, 3)) for t in texts]


def test_fingerprints_do_not_depend_on_the_place():
    (one,) = every_slice(["xx the cat", None, "the cat", "thecat"], 1000)
    words = T.words(one)
    hashes = T.span_hashes(one.data, words.start, words.end)
    assert hashes[1] == hashes[3] and hashes[2] == hashes[4]
    assert len(set(hashes.tolist())) == 4


def test_long_words_and_pieces(monkeypatch):
    monkeypatch.setattr(T, "_HASH_BYTES", 50)
    long_ = "a" * 300
    texts = [f"{long_} b {long_}", "c " * 200 + long_]
    (part,) = every_slice(texts, 10**6)
    words = T.words(part)
    hashes = T.span_hashes(part.data, words.start, words.end)
    same = hashes[words.end - words.start == 300]
    assert len(same) == 3 and len(set(same.tolist())) == 1


@pytest.mark.parametrize("n", [1, 4, 9])
def test_sliding_hashes(n):
    data = np.frombuffer(b"abcabcabdabcabc", np.uint8)
    hashes = T.sliding_hashes(data, n).tolist()
    pieces = [data[i : i + n].tobytes() for i in range(len(data) - n + 1)]
    assert len(set(hashes)) == len(set(pieces))
    assert {h: p for h, p in zip(hashes, pieces)} == dict(zip(hashes, pieces))
    assert all((hashes[i] == hashes[j]) == (p == q) for i, p in enumerate(pieces) for j, q in enumerate(pieces))


def test_powers():
    assert T.powers(3, 5).tolist() == [1, 3, 9, 27, 81]
    assert T.powers(3, 0).tolist() == []


def test_lowering_touches_ascii_only():
    (part,) = every_slice(["ÀB Éa"], 100)
    assert T.LOWER[part.data].tobytes().decode() == "Àb Éa"
    assert re.findall("b", "Àb")


X, Y = brute.thue_morse(2048), brute.thue_morse(2048, "b", "a")


def test_patterns_do_not_collide():
    data = np.frombuffer(f"{X} {Y}".encode(), np.uint8)
    start, end = np.array([0, 2049]), np.array([2048, 4097])
    for seed in (1, 2):
        hashes = T.unit_hashes(data, start, end, seed)
        assert hashes[0] != hashes[1]
        values = T.mix(data.astype(np.uint64))
        runs = T.run_hashes(values, start, end, seed)
        assert runs[0] != runs[1]
    one, two = T.shingle_sets(next(T.text_slices(pa.array([X, Y]))), 4)
    assert one.tolist() != two.tolist()


@given(st.lists(st.binary(min_size=1, max_size=9), min_size=1, max_size=9))
def test_equal_units_have_equal_hashes(units):
    data = np.frombuffer(b" ".join(units) + b" ", np.uint8)
    end = np.cumsum([len(u) + 1 for u in units]) - 1
    start = end - [len(u) for u in units]
    for seed in (1, 2):
        hashes = T.unit_hashes(data, start, end, seed).tolist()
        assert len(set(zip(units, hashes))) == len(set(units)) == len(set(hashes))


@given(st.lists(st.integers(0, 2**61 - 2), min_size=1, max_size=30), st.integers(1, 2**61 - 2))
def test_arithmetic_modulo_the_prime(values, base):
    a = np.array(values, np.uint64)
    p = T.PRIME
    assert T.times(a, np.uint64(base)).tolist() == [v * base % p for v in values]
    assert T.prime_powers(base, len(a)).tolist() == [pow(base, i, p) for i in range(len(a))]
    assert T.prime_sums(a).tolist() == [sum(values[:i]) % p for i in range(len(a) + 1)]
