"""The n-gram join against all pairs."""

from __future__ import annotations

import random
import weakref

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayrate.llm import ngram_join as N

FOLDER = "/root/testdata/sf0.001"


def joined(df, **options):
    return {
        r["doc_id"]: (r["n_shingles"], r["component_id"])
        for r in N.jaccard_components(df, **options).collect()
    }


def family(rng, base, copies, most):
    """Copies of a text with up to ``most`` words replaced."""
    out = []
    for _ in range(copies):
        words = base.split()
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 30)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def families():
    rng = random.Random(3)
    texts = []
    for size, copies, most in ((60, 60, 6), (150, 40, 16), (8, 12, 1), (25, 30, 3)):
        base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(size))
        texts += family(rng, base, copies, most)
    texts += ["", None, "  \n\t ", "one", "one", "one two three", "One TWO three", "é é é é é"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_families_of_copies(spark, families):
    df = spark.createDataFrame(list(families.items()), "doc_id long, text string")
    assert joined(df.repartition(5)) == brute.components(families)


def test_other_limits(spark, families):
    df = spark.createDataFrame(list(families.items()), "doc_id long, text string")
    assert joined(df, n=2, percent=70) == brute.components(families, 2, 70)


def test_documents(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert joined(df) == brute.components(texts)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for _ in range(300):
        size = int(rng.integers(1, 120))
        base = rng.integers(1, 2**63, size, dtype=np.uint64)
        other = base.copy()
        for _ in range(int(rng.integers(0, max(1, size // 8) + 1))):
            kind = rng.integers(3)
            if kind == 0 and len(other) > 1:
                other = np.delete(other, rng.integers(len(other)))
            elif kind == 1:
                other = np.append(other, rng.integers(1, 2**63, dtype=np.uint64))
            else:
                other[rng.integers(len(other))] = rng.integers(1, 2**63, dtype=np.uint64)
        common = len(np.intersect1d(base, other))
        if 100 * common >= 85 * (len(base) + len(other) - common):
            a, b = (N.signatures(np.unique(s), 85) for s in (base, other))
            assert np.intersect1d(a, b).size


def test_repeated_and_missing_ids_and_extra_columns(spark):
    rows = [
        (1, "a b c d e", 1, "x"),
        (1, "a b c d e", 2, "y"),
        (2, "a b c d e", 3, None),
        (3, "p q r s t", 4, "x"),
        (3, "u v w x y", 5, "x"),
        (4, "u v w x y", 6, "x"),
        (None, "a b c d e", 7, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles long, component_id string")
    got = sorted(
        (tuple(r) for r in N.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()),
        key=repr,
    )
    # Document 3 has two texts, so it links to 4; the row without id links with nothing.
    assert got == sorted(
        [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 3), (3, 2, 3), (4, 2, 3), (None, 2, None)], key=repr
    )


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.jaccard_components(df).collect() == []


def test_one_large_group_of_equal_texts(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("the same text in every one of them").alias("text")
    )
    assert set(joined(df).values()) == {(5, 0)}


def test_patterned_words_do_not_link(spark):
    x, y = brute.thue_morse(2048), brute.thue_morse(2048, "b", "a")
    rows = [(1, x), (2, y), (3, x + "  "), (4, f"{x} {y}")]
    got = joined(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 4)}


def test_family_with_strays(spark):
    """A large family of near copies, one bridge out of it, and documents that only look alike."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        words = list(base)
        words[(7 * i) % 200] = f"x{i}"
        rows.append((i, " ".join(words)))
    words = list(base)
    for step in range(12):  # a chain that leaves the family step by step
        words[5 + 16 * step] = f"chain{step}"
        rows.append((1000 + step, " ".join(words)))
    for i in range(40):  # 60 % of the family's words
        rows.append((2000 + i, " ".join(base[:120] + [f"y{i}z{j}" for j in range(80)])))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert joined(frame, n=5, percent=80) == brute.components(dict(rows), 5, 80)


def test_sketches_are_lower_bounds(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(N, "SKETCH_BITS", 1 << 11)
    base = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    sets = [np.zeros(0, np.uint64)]
    for size in (1, 5, 31, 33, 60, 64, 500, 520, 1500, 3000):
        for changed in (0, 1, size // 8, size):
            own = base[:size].copy()
            own[:changed] = rng.integers(1, 2**63, changed, dtype=np.uint64)
            sets.append(np.unique(own))
    sketch = [N.parity_sketch(s) for s in sets]
    assert {len(s) for s in sketch} == {8, 16, 128, 256}
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    found = N.fewest_apart(np.array([len(s) for s in sets]), sketch, i, j)
    apart = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(i, j)])
    assert (found <= apart).all() and (found[i == j] == 0).all()
    assert not N.may_link(found, np.array([len(sets[x]) + len(sets[y]) for x, y in zip(i, j)]), 80)[
        apart > 0.9 * np.array([len(sets[x]) + len(sets[y]) for x, y in zip(i, j)])
    ].any()


def strays_and_a_family():
    """A family, a second one linked to it by one document only, and texts that share a passage."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        words[(7 * i) % 200] = f"x{i}"
        rows.append((i, " ".join(words)))
    words = list(base)
    for step in range(14):
        words[5 + 14 * step] = f"chain{step}"
        rows.append((1000 + step, " ".join(words)))
    for i in range(60):
        words[190 + i % 9] = f"end{i}"
        rows.append((1500 + i, " ".join(words)))
    for i in range(80):
        rows.append((2000 + i, " ".join(base[:120] + [f"y{i}z{j}" for j in range(80)])))
    return rows


@pytest.mark.parametrize("strays", [N.STRAYS, 0])
def test_strays_meet_by_sketches_or_by_shares(spark, monkeypatch, strays):
    rows = strays_and_a_family()
    monkeypatch.setattr(N, "STRAYS", strays)
    monkeypatch.setattr(N, "PIECE", 50)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert joined(frame, n=5, percent=80) == brute.components(dict(rows), 5, 80)


def test_texts_are_read_only_for_pairs_that_may_link(spark, monkeypatch):
    """Texts that share a passage meet in buckets; neither they nor their differences are shuffled."""
    rows = strays_and_a_family()
    confirmed, compared = N.confirmed, []

    def counted(pairs, *rest):
        compared.extend(tuple(r) for r in pairs.collect())
        return confirmed(pairs, *rest)

    def refuse(*_):
        raise AssertionError("differences of a small group were written out")

    monkeypatch.setattr(N, "confirmed", counted)
    monkeypatch.setattr(N, "differences", refuse)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert joined(frame, n=5, percent=80) == brute.components(dict(rows), 5, 80)
    assert compared and not any(2000 <= max(a, b) for a, b, *_ in compared)


def test_a_task_keeps_few_bytes_of_sets(spark, monkeypatch):
    """Long texts: the sets kept by a task are bounded by their bytes, not only by their number."""
    monkeypatch.setattr(N, "SETS_BYTES", 60_000, raising=False)
    monkeypatch.setattr(N, "PACKED_BYTES", 20_000, raising=False)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(1000)) for _ in range(100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    pairs = [(i, j) for i in range(0, 100, 10) for j in range(i + 1, i + 10)]
    seen = []

    def measure(x, y):
        seen.extend(weakref.ref(s) for s in (x, y))
        held = {id(s): s.nbytes for r in seen if (s := r()) is not None}
        return len(x) + len(y), sum(held.values())

    found = N.pairwise(
        spark.createDataFrame(pairs, "a bigint, b bigint").coalesce(1),
        N.packed(rows, "text"),
        4,
        {"total": pa.int64(), "held": pa.int64()},
        measure,
    ).collect()
    assert sorted((r["a"], r["b"]) for r in found) == pairs
    assert {r["total"] for r in found} == {2 * 997}
    assert max(r["held"] for r in found) <= 200_000  # all sets take 797,600
