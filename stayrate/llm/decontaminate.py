"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit distance.

The embedding walks through a window of words: at step ``t`` it notes the word it stands on and
steps ahead if a random bit of (``t``, word) says so. Two windows at small edit distance note equal
words at most steps, so edit distance becomes Hamming distance. A repetition draws its own bits and
a few steps to sample; the sampled words are the window's key. Items make windows at the first words
of their two halves, in bands by the power of two their length reaches; texts make windows at every
word pair that begins an item's window. A key grows step by step, and windows whose key so far is
not one of an item's leave at once. For each class of lengths (a power of two), repetitions are added
until items of the class, with all the edits they may have, are found with the ``recall`` asked for.
An unchanged item is always found, as sampled steps stay inside the window.

Items of fewer than ``EXACT_BELOW`` words, and classes that miss the recall after
``MOST_REPETITIONS``, are looked up exactly instead: an item is cut into one run of words more than
the edits it may have, so a leak holds at least one run unchanged, and wherever a run stands in a text
the item is compared with the words around it, many places at once.

Candidates are confirmed by the edit distance between the item and the text around the window, in
words (A-Z lowered): at most ``max_edits`` of the item's words, so items of a few words are found
unchanged only. Null items and items without words are left out.

The benchmark is worked off in blocks of about ``BLOCK_BYTES``, one pass over the texts for each;
the blocks alone are sent to the workers. Rows are judged one by one: null or empty texts have no
hits, repeated rows and null ids change nothing. All columns are kept; a column named like the one
added is replaced.
Items that repeat count each; an item without id has a null id in its hits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.shared import small_batches
from stayrate.llm.text import (
    LOWER,
    mix,
    mix_int,
    sequence_hashes,
    span_hashes,
    text_slices,
    words,
)

MIN_WORDS = 5  # in a window
EXACT_BELOW = 16
SEED_WORDS = 8  # looked at of an unchanged run
SEED_PAIRS = 1 << 18  # places compared at once
STARTS = 4  # windows per half of an item
SAMPLED = 3  # steps in a key, besides the two words at the start
MOST_REPETITIONS = 32
TRIAL_ITEMS = 100  # items of a class that recall is measured on
TRIALS = 4  # mutations of each; more if there are fewer items
BLOCK_BYTES = 16 << 20

HIT = "struct<item_id:bigint,edits:bigint,n_words:bigint,start:bigint,end:bigint>"


def tokens_of(text: str) -> np.ndarray:
    for part in text_slices(pa.array([text])):
        found = words(part)
        return span_hashes(LOWER[part.data], found.start, found.end)
    return np.zeros(0, np.uint64)


def band_of(size: int) -> int:
    return 1 << (size.bit_length() - 1)


def item_starts(size: int) -> list[int]:
    starts = {h + i for h in (0, size // 2) for i in range(STARTS)}
    return sorted(s for s in starts if size - s >= MIN_WORDS)


def samples(repetition: int, band: int) -> np.ndarray:
    """Ascending steps, all below ``band``, whose words make the key."""
    rng = np.random.default_rng([repetition, band])
    return np.sort(rng.choice(np.arange(1, band), min(SAMPLED, band - 1), replace=False))


def walk(
    tokens: np.ndarray, at: np.ndarray, repetition: int, band: int, allowed: list[np.ndarray] | None
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of the windows at ``at``: all partial keys, the final keys and their windows.

    ``allowed`` holds, for each sampled step, a table of the low 16 bits that keys may have.
    """
    position = at.copy()
    key = np.full(len(at), mix_int(repetition * 1_000_003 + band), np.uint64)
    key = mix(key + tokens[at] * np.uint64(3) + tokens[at + 1])
    partial: list[np.ndarray] = []
    steps = samples(repetition, band)
    for t in range(int(steps[-1]) + 1):
        if len(partial) < len(steps) and t == steps[len(partial)]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + tokens[position])
            if allowed is not None:
                keep = allowed[len(partial)][key & np.uint64(0xFFFF)]
                at, position, key = at[keep], position[keep], key[keep]
            partial.append(key)
        odd = np.uint64(mix_int((repetition << 32) + t) | 1)
        position = position + (tokens[position] * odd >> np.uint64(63)).astype(np.int64)
    return partial, key, at


class Level(NamedTuple):
    """Keys of one repetition and band, sorted, with item and start, and the tables of partial keys."""

    repetition: int
    band: int
    allowed: list[np.ndarray]
    keys: np.ndarray
    item: np.ndarray
    start: np.ndarray


class Seeds(NamedTuple):
    """Fingerprints of runs of ``size`` words, sorted, with the item and the place of the run in it."""

    size: int
    table: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray


class Index(NamedTuple):
    ids: list[int | None]
    tokens: list[np.ndarray]
    pairs: np.ndarray  # sorted fingerprints of the two words at which windows begin
    table: np.ndarray
    levels: list[Level]
    seeds: list[Seeds]


def build(
    ids: list[int | None],
    tokens: list[np.ndarray],
    repetitions: list[range],
    seeds: Iterable[Seeds] = (),
) -> Index:
    """Index with the repetitions of each item; those without any rely on ``seeds``."""
    bands: dict[int, list[tuple[int, int]]] = {}
    pairs = set()
    for i, t in enumerate(tokens):
        begins = sequence_hashes(t, 2)
        for start in item_starts(len(t)) if repetitions[i] else ():
            bands.setdefault(band_of(len(t) - start), []).append((i, start))
            pairs.add(int(begins[start]))
    flat = np.concatenate([*tokens, np.zeros(1, np.uint64)])
    base = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
    levels = []
    for band, places in sorted(bands.items()):
        for repetition in sorted({r for i, _ in places for r in repetitions[i]}):
            here = [(i, start) for i, start in places if repetition in repetitions[i]]
            item, start = (np.array(c) for c in zip(*here))
            partial, key, _ = walk(flat, base[item] + start, repetition, band, None)
            allowed = []
            for values in partial:
                table = np.zeros(1 << 16, bool)
                table[values & np.uint64(0xFFFF)] = True
                allowed.append(table)
            order = np.argsort(key)
            levels.append(
                Level(repetition, band, allowed, key[order], item[order], start[order])
            )
    known = np.array(sorted(pairs), np.uint64)
    table = np.zeros(1 << 16, bool)
    table[known & np.uint64(0xFFFF)] = True
    return Index(ids, tokens, known, table, levels, list(seeds))


def seeds_of(tokens: list[np.ndarray], items: list[int], max_edits: float) -> list[Seeds]:
    """Runs of the ``items`` of which the allowed edits leave at least one as it is."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for i in items:
        n = len(tokens[i])
        parts = min(int(max_edits * n), n - 1) + 1
        cuts = [k * n // parts for k in range(parts + 1)]
        for a, b in zip(cuts, cuts[1:]):
            size = min(b - a, SEED_WORDS)
            key = sequence_hashes(tokens[i][a : a + size], size)[0]
            runs.setdefault(size, []).append((int(key), i, a))
    out = []
    for size, found in sorted(runs.items()):
        keys, item, offset = (np.array(c, t) for c, t in zip(zip(*sorted(found)), ("u8", "i8", "i8")))
        table = np.zeros(1 << 16, bool)
        table[keys & np.uint64(0xFFFF)] = True
        out.append(Seeds(size, table, keys, item, offset))
    return out


def seeded(
    index: Index, tokens: np.ndarray, begin: np.ndarray, end: np.ndarray, max_edits: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, items, offsets) of the runs around which an item lies within its edits."""
    sizes = np.array([len(t) for t in index.tokens])
    base = np.cumsum(sizes) - sizes
    flat = np.concatenate(index.tokens)
    for seeds in index.seeds:
        runs = sequence_hashes(tokens, seeds.size)
        at = np.flatnonzero(seeds.table[runs & np.uint64(0xFFFF)])
        at = at[at + seeds.size <= end[at]]
        low = np.searchsorted(seeds.keys, runs[at], "left")
        count = np.searchsorted(seeds.keys, runs[at], "right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        total = np.cumsum(count)
        done = 0
        while done < len(at):
            before = int(total[done - 1]) if done else 0
            last = max(int(np.searchsorted(total, before + SEED_PAIRS, "right")), done + 1)
            many = count[done:last]
            row = np.repeat(np.arange(done, last), many)
            match = low[row] + np.arange(len(row)) - np.repeat(total[done:last] - many - before, many)
            place, item, offset = at[row], seeds.item[match], seeds.offset[match]
            for n in np.unique(sizes[item]).tolist():
                most = int(max_edits * n)
                chosen = np.flatnonzero(sizes[item] == n)
                step = max(1, SEED_PAIRS // (n + 2 * most + 1))
                for k in range(0, len(chosen), step):
                    c = chosen[k : k + step]
                    near = place[c][:, None] - offset[c][:, None] + np.arange(-most, n + most)
                    inside = (near >= begin[place[c]][:, None]) & (near < end[place[c]][:, None])
                    words_near = tokens[np.clip(near, 0, len(tokens) - 1)]
                    wanted = flat[base[item[c]][:, None] + np.arange(n)]
                    c = c[least_edits(wanted, words_near, inside) <= most]
                    if len(c):
                        yield place[c], item[c], offset[c]
            done = last


def least_edits(items: np.ndarray, texts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Row by row the least edit distance of an item to a stretch of the words ``inside`` a text."""
    steps = np.arange(texts.shape[1] + 1)
    row = np.zeros((len(texts), len(steps)), np.int64)
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        differ = (texts != items[:, i : i + 1]) | ~inside
        new[:, 1:] = np.minimum(row[:, :-1] + differ, row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row.min(axis=1)


def candidates(
    index: Index, tokens: np.ndarray, end: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, items, starts) of the windows whose key is an item's."""
    if len(tokens) < 2 or not len(index.pairs):
        return
    begins = sequence_hashes(tokens, 2)
    at = np.flatnonzero(index.table[begins & np.uint64(0xFFFF)] & (end[:-1] - np.arange(len(begins)) > 1))
    place = np.searchsorted(index.pairs, begins[at])
    at = at[index.pairs[np.minimum(place, len(index.pairs) - 1)] == begins[at]]
    for level in index.levels:
        fits = at[at + level.band <= end[at]]
        if not len(fits):
            continue
        _, key, where = walk(tokens, fits, level.repetition, level.band, level.allowed)
        low = np.searchsorted(level.keys, key, "left")
        count = np.searchsorted(level.keys, key, "right") - low
        row = np.repeat(np.arange(len(key)), count)
        if not len(row):
            continue
        match = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        yield where[row], level.item[match], level.start[match]


def best_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between ``item`` and any stretch of ``text``, and where that ends."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


def align(
    item: np.ndarray, tokens: np.ndarray, at: int, low: int, high: int, most: int
) -> tuple[int, int, int] | None:
    """(edits, first word, word after the last) of the item near ``at``; None beyond ``most``."""
    n = len(item)
    if low <= at and at + n <= high and np.array_equal(tokens[at : at + n], item):
        return 0, at, at + n
    a, b = max(low, at - most), min(high, at + n + most)
    edits, end = best_edits(item, tokens[a:b])
    if edits > most:
        return None
    _, size = best_edits(item[::-1], tokens[a : a + end][::-1])
    return edits, a + end - size, a + end


def mutated(tokens: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """``tokens`` after random replacements, insertions and deletions of words."""
    out = tokens.tolist()
    for _ in range(edits):
        kind, word = rng.integers(3), int(rng.integers(1, 2**63))
        spot = int(rng.integers(len(out) + (kind == 1))) if out else 0
        if kind == 0 and out:
            out[spot] = word
        elif kind == 1 or not out:
            out.insert(spot, word)
        else:
            del out[spot]
    return np.array(out, np.uint64)


def repetitions_for(tokens: list[np.ndarray], max_edits: float, recall: float) -> int | None:
    """The fewest repetitions that find mutated items of a bounded trial often enough, if any."""
    rng = np.random.default_rng(5)
    chosen = [tokens[i] for i in rng.permutation(len(tokens))[:TRIAL_ITEMS]]
    trials = max(TRIALS, TRIALS * TRIAL_ITEMS // len(chosen))
    texts = [
        mutated(item, int(max_edits * len(item)), rng) for item in chosen for _ in range(trials)
    ]
    flat = np.concatenate(texts)
    last = np.cumsum([len(t) for t in texts])
    trial = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found = np.zeros(len(texts), bool)
    for repetition in range(MOST_REPETITIONS):
        index = build(list(range(len(chosen))), chosen, [range(repetition, repetition + 1)] * len(chosen))
        for where, item, _ in candidates(index, flat, last[trial]):
            of = trial[where]
            found[of[item == of // trials]] = True
        if found.mean() >= recall:
            return repetition + 1
    return None


def index_of(
    ids: list[int | None], tokens: list[np.ndarray], max_edits: float, recall: float
) -> Index:
    """Repetitions by class of lengths, and exact runs where they are too few words or miss the recall."""
    classes: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        if len(t) >= EXACT_BELOW:
            classes.setdefault(band_of(len(t)), []).append(i)
    repetitions = [range(0)] * len(tokens)
    for items in classes.values():
        enough = repetitions_for([tokens[i] for i in items], max_edits, recall)
        for i in items:
            repetitions[i] = range(enough or 0)
    exact = [i for i, r in enumerate(repetitions) if not r]
    return build(ids, tokens, repetitions, seeds_of(tokens, exact, max_edits))


def _search(index: Index, max_edits: float, columns: list[str]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: list[list[dict]] = [list(h) for h in batch.column(1).to_pylist()]
            for part in text_slices(batch.column(0)):
                found = words(part)
                tokens = span_hashes(LOWER[part.data], found.start, found.end)
                first = np.searchsorted(found.text, np.arange(part.last - part.first + 1))
                end = first[1:][found.text]
                begin = first[:-1][found.text]
                tried: set[tuple[int, int, int]] = set()
                for where, item, start in chain(
                    candidates(index, tokens, end), seeded(index, tokens, begin, end, max_edits)
                ):
                    rows = found.text[where]
                    tried.update(zip(rows.tolist(), item.tolist(), (where - start).tolist()))
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for row, i, at in sorted(tried):
                    low, high = int(first[row]), int(first[row + 1])
                    most = int(max_edits * len(index.tokens[i]))
                    got = align(index.tokens[i], tokens, at, low, high, most)
                    if got and got < best.get((row, i), (1 << 62, 0, 0)):
                        best[row, i] = got
                for (row, i), (edits, a, b) in sorted(best.items()):
                    offset = int(part.offsets[row])
                    hits[part.first + row].append(
                        {
                            "item_id": index.ids[i],
                            "edits": edits,
                            "n_words": len(index.tokens[i]),
                            "start": int(found.start[a]) - offset,
                            "end": int(found.end[b - 1]) - offset,
                        }
                    )
            kind = pa.struct([(f, pa.int64()) for f in ("item_id", "edits", "n_words", "start", "end")])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hits, pa.list_(kind)), *batch.columns[2:]],
                names=columns,
            )

    return search


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    max_edits: float = 0.2,
    recall: float = 0.95,
    text_col: str = "text",
    to: str = "hits",
) -> DataFrame:
    """``docs`` with the list ``to``: for each item found the fewest edits and the byte range."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != to]
    others = [c for c in kept if c != text_col]
    items = benchmark.selectExpr("CAST(item_id AS BIGINT) AS item_id", "text").filter(
        "text IS NOT NULL"
    )
    total = items.agg(F.expr("coalesce(sum(octet_length(text)), 0)")).first()[0]
    blocks = int(total) // BLOCK_BYTES + 1
    found = docs.selectExpr(
        f"`{text_col}`", f"CAST(array() AS array<{HIT}>) AS `{to}`", *(f"`{c}`" for c in others)
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    for block in range(blocks):
        part = items.filter(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {block}"))
        pairs = [(r["item_id"], tokens_of(r["text"])) for r in part.collect()]
        pairs = sorted(
            ((i, t) for i, t in pairs if len(t)),
            key=lambda p: (p[0] is None, p[0] or 0, p[1].tobytes()),
        )
        if pairs:
            ids, tokens = [i for i, _ in pairs], [t for _, t in pairs]
            index = index_of(ids, tokens, max_edits, recall)
            found = found.mapInArrow(_search(index, max_edits, found.columns), schema)
    return found.select(*(f"`{c}`" for c in [*kept, to]))
