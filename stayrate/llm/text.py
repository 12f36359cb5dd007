"""Words, shingles and their 64-bit fingerprints for Arrow text columns, without a loop over words.

All functions work on slices of a few megabytes, so memory does not depend on the batch size.
Words and lines are hashed by a sum of byte values, each times a random number that belongs to its
place (:func:`unit_hashes`). Windows that overlap, of less than 1,024 bytes, are hashed by polynomials
modulo 2**64; those of longer ranges vanish on some patterns whatever the base is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_HASH_BYTES = (1 << 20) + 4096

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out[:n]


class _Powers:
    """Powers of the base and of its inverse, made when first asked for and never pickled."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            most = max(n, _HASH_BYTES + 1)
            up, down = powers(_BASE, most), powers(_INVERSE, most)
            if n > _HASH_BYTES + 1:
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_powers = _Powers()


def byte_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers.get(n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


class Texts(NamedTuple):
    """Rows ``first`` to ``last`` of a text column: their bytes, and where each text begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a column into runs of whole texts of about ``max_bytes``; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    _, where, content = column.buffers()
    n = len(column)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1] if n else []
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        begin, end = int(offsets[first]), int(offsets[last])
        yield Texts(first, last, data[begin:end], offsets[first : last + 1] - begin)
        first = last


class Words(NamedTuple):
    """Words of some texts in order: first byte, byte after the last, number of the text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def words(texts: Texts) -> Words:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and return."""
    inside = ~SPACE[texts.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[texts.offsets] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(start, end, np.searchsorted(texts.offsets, start, "right") - 1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of byte ranges in ascending order, a megabyte of ranges at a time."""
    out = np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):
        begin = int(start[done])
        last = max(int(np.searchsorted(end, begin + _HASH_BYTES, "right")), done + 1)
        stop = int(end[last - 1])
        up, down = byte_powers(stop - begin + 1)
        total = np.zeros(stop - begin + 1, np.uint64)
        np.cumsum(_BYTE[data[begin:stop]] * up[:-1], out=total[1:])
        a, b = start[done:last] - begin, end[done:last] - begin
        out[done:last] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        done = last
    return out


def _place_keys(first: int, n: int, seed: int) -> np.ndarray:
    """Random odd numbers that belong to the places ``first`` to ``first + n - 1``."""
    places = np.arange(first, first + n, dtype=np.uint64)
    return mix(places * np.uint64(0x9E3779B97F4A7C15) + np.uint64(mix_int(seed))) | np.uint64(1)


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """Fingerprints of runs ``values[start:end]``, ascending, apart and not empty, a slice at a time.

    Each value counts times a random number for its place in the run, so no pattern of values cancels
    another but by chance. Other seeds give independent fingerprints.
    """
    out = np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):
        begin = int(start[done])
        last = max(int(np.searchsorted(end, begin + _HASH_BYTES, "right")), done + 1)
        a, b = start[done:last] - begin, end[done:last] - begin
        size = b - a
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
        keys = _place_keys(0, int(size.max()), seed)
        terms = values[begin + place + np.repeat(a, size)] * keys[place]
        sums = np.add.reduceat(terms, ends - size)
        out[done:last] = mix(sums + size.astype(np.uint64) * np.uint64(mix_int(seed + 1000) | 1))
        done = last
    return out


_BYTES = {seed: mix(np.arange(256, dtype=np.uint64) + np.uint64(mix_int(seed + 77))) for seed in (1, 2)}


def unit_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """Fingerprints of words or lines: byte ranges, ascending, apart and not empty."""
    out = np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):  # a megabyte at a time, as the values of its bytes take eight
        begin = int(start[done])
        last = max(int(np.searchsorted(end, begin + _HASH_BYTES, "right")), done + 1)
        stop = int(end[last - 1])
        values = _BYTES[seed][data[begin:stop]]
        out[done:last] = run_hashes(values, start[done:last] - begin, end[done:last] - begin, seed)
        done = last
    return out


# Arithmetic modulo the prime 2**61 - 1, where powers of a base have no zero divisors to vanish on.
PRIME = (1 << 61) - 1


def mod_prime(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products of numbers below the prime, modulo the prime."""
    low31, low30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low31, b >> np.uint64(31), b & low31
    middle = a0 * b1 + a1 * b0
    high = a1 * b1 * np.uint64(2) + (middle >> np.uint64(30))
    return mod_prime(high + ((middle & low30) << np.uint64(31)) + a0 * b0)


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo the prime, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = times(out[:more], np.uint64(pow(base, have, PRIME)))
        have += more
    return out[:n]


def prime_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... n numbers below the prime, modulo the prime."""
    low = np.cumsum(values & np.uint64((1 << 30) - 1))
    high = mod_prime(np.cumsum(values >> np.uint64(30)))
    total = mod_prime(times(high, np.uint64(1 << 30)) + mod_prime(low))
    return np.concatenate((np.zeros(1, np.uint64), total))


def sliding_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of ``n`` consecutive bytes."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    up, down = byte_powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(data) - n + 1])


_ORDER = np.array([mix_int(1000 + i) | 1 for i in range(64)], np.uint64)


def sequence_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of ``n`` consecutive tokens (runs may cross texts)."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    size = len(tokens) - n + 1
    out = np.full(size, n, np.uint64)
    for i in range(n):
        out += tokens[i : i + size] * _ORDER[i]
    return mix(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; plain sorting beats ``np.unique`` on small arrays."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def shingle_sets(texts: Texts, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct fingerprints of its ``n``-word shingles, A-Z lowered.

    A text with fewer words has its whole sequence as its only shingle, without words none.
    """
    data = LOWER[texts.data]
    found = words(texts)
    tokens = unit_hashes(data, found.start, found.end)
    runs = sequence_hashes(tokens, n)
    first = np.searchsorted(found.text, np.arange(texts.last - texts.first + 1))
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            sets.append(distinct(runs[a : b - n + 1]))
        elif b > a:
            sets.append(sequence_hashes(tokens[a:b], int(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
