"""Quality rules on repetition: suffix arrays over the words of each text.

Prefix doubling sorts the suffixes of all texts of a slice at once; a suffix whose rank is unique
leaves the sort. The longest common prefix of neighbours in that order gives each position its
longest repeat; the intervals of equal prefixes are the maximal repeated substrings, and the union
of their spans is the repeated part. A text is kept unless it fails the base rules, more than
``max_covered`` percent of its words lie in repeats of at least ``min_repeat`` words, or one repeat
is longer than ``max_repeat`` words.

Words are runs of characters other than ASCII white space, lines are split at line feeds. A null or
empty text has no words, so it fails the base rules. Rows are judged one by one: ties, repeated rows
and null ids change nothing. Columns besides id and text are ignored, or kept by
:func:`with_quality`. Memory follows the longest text, about 60 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stayrate.llm.shared import fresh, small_batches
from stayrate.llm.text import (
    PRIME,
    SPACE,
    Texts,
    mix,
    mod_prime,
    prime_powers,
    prime_sums,
    text_slices,
    times,
    unit_hashes,
    words,
)

WINDOW = 5  # fixed by the base rules
SYMBOLS = b"#*$%&|<>"  # fixed by the base rules
MIN_WORDS = 10  # fixed by the base rules
MAX_REPEATED = 20  # percent, fixed by the base rules

MIN_REPEAT = 10
MAX_COVERED = 20
MAX_REPEAT = 50


def suffix_order(tokens: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes ``tokens[i:end[i]]``, suffixes of a text together.

    ``tokens`` must differ between texts.
    """
    n = len(tokens)
    order = np.argsort(tokens)
    new = np.concatenate(([True], tokens[order][1:] != tokens[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
    slots = np.arange(n)
    offset = 1
    while True:
        ranks = rank[order[slots]]
        same = ranks[1:] == ranks[:-1]
        shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        slots = slots[shared]
        if not len(slots):
            return order
        where = order[slots]
        after = where + offset
        second = np.where(after < end[where], rank[np.minimum(after, n - 1)], 0)
        key = rank[where] * (n + 1) + second
        by = np.argsort(key)
        order[slots], key = where[by], key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] + 1
        offset *= 2


def common_prefixes(
    tokens: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray
) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and at ``b``."""
    if not len(a):
        return np.zeros(0, np.int64)
    base = 0x1142543DE82EF953
    values = mod_prime(mix(tokens))
    total = prime_sums(times(values, prime_powers(base, len(tokens))))
    down = prime_powers(pow(base, -1, PRIME), len(tokens) + 1)
    most = np.minimum(end[a] - a, end[b] - b)
    found = np.zeros(len(a), np.int64)
    step = 1 << int(most.max()).bit_length()
    while step:
        fits = np.flatnonzero(found + step <= most)
        i, j = a[fits] + found[fits], b[fits] + found[fits]
        first, second = (
            times(mod_prime(total[k + step] + np.uint64(PRIME) - total[k]), down[k]) for k in (i, j)
        )
        equal = first == second
        found[fits[equal]] += step
        step //= 2
    return found


def longest_repeats(tokens: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """For each position the longest string there that the text holds twice; 0 below ``least``."""
    longest = np.zeros(len(tokens), np.int64)
    if not len(tokens):
        return longest
    order = suffix_order(tokens, end)
    a, b = order[:-1], order[1:]
    near = (tokens[a] == tokens[b]) & (a + least <= end[a]) & (b + least <= end[b])
    for i in range(1, least):
        a, b = a[near], b[near]
        near = tokens[a + i] == tokens[b + i]
    a, b = a[near], b[near]
    size = common_prefixes(tokens, end, a, b)
    np.maximum.at(longest, a, size)
    np.maximum.at(longest, b, size)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Marks the positions inside a repeat of at least ``least`` words."""
    at = np.arange(len(longest))
    return np.maximum.accumulate(np.where(longest >= least, at + longest, 0)) > at


class Measures(NamedTuple):
    """Counts per text of a slice."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    covered_words: np.ndarray
    longest_repeat: np.ndarray


_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_CHAR = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)


def measures(texts: Texts, min_repeat: int) -> Measures:
    n, edges = texts.last - texts.first, texts.offsets

    def per_text(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(marks)))[edges])

    found = words(texts)
    first = np.searchsorted(found.text, np.arange(n + 1))
    tokens = mix(
        unit_hashes(texts.data, found.start, found.end)
        + mix(found.text.astype(np.uint64) + np.uint64(77))
    )
    longest = longest_repeats(tokens, first[1:][found.text], min(WINDOW, min_repeat))

    feeds = np.flatnonzero(texts.data == 10)
    line = np.unique(np.concatenate((edges[:-1], feeds + 1)))
    line = line[line < len(texts.data)]
    stop = np.concatenate((line[1:], [len(texts.data)])) if len(line) else line
    stop = stop - (texts.data[stop - 1] == 10)
    filled = np.searchsorted(found.start, line) < np.searchsorted(found.start, stop)
    line, stop = line[filled], stop[filled]
    text = np.searchsorted(edges, line, "right") - 1
    content = mix(
        unit_hashes(texts.data, line, stop) + mix(text.astype(np.uint64) + np.uint64(7777))
    )
    order = np.argsort(content, kind="stable")
    again = content[order][1:] == content[order][:-1]

    most = np.zeros(n, np.int64)
    np.maximum.at(most, found.text, longest)
    return Measures(
        np.diff(first),
        per_text(_CHAR[texts.data], edges),
        per_text(_SYMBOL[texts.data], edges),
        np.bincount(text[order[1:][again]], minlength=n),
        per_text(covered(longest, WINDOW), first),
        per_text(covered(longest, min_repeat), first),
        most,
    )


def with_quality(
    docs: DataFrame,
    to: str,
    min_repeat: int = MIN_REPEAT,
    max_covered: int = MAX_COVERED,
    max_repeat: int = MAX_REPEAT,
    text_col: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with a struct ``to``: the seven measures, base_failed and kept."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]
    kept = [text_col, *others] if keep_text else others
    measure = fresh("measures", docs.columns)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    struct = ", ".join(f"{name}: bigint" for name in Measures._fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measures(part, min_repeat) for part in text_slices(batch.column(0))]
            counts = [np.concatenate(c).astype(np.int64) for c in zip(*parts)]
            counts = counts or [np.zeros(0, np.int64)] * len(Measures._fields)
            found = pa.StructArray.from_arrays([pa.array(c) for c in counts], Measures._fields)
            columns = batch.columns if keep_text else batch.columns[1:]
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*kept, measure])

    measured = docs.select(text_col, *others).mapInArrow(
        judge, ", ".join([*fields, f"`{measure}` struct<{struct}>"])
    )
    m = f"`{measure}`"
    failed = (
        f"({m}.n_words < {MIN_WORDS} OR 100 * {m}.n_repeat_words > {MAX_REPEATED} * {m}.n_words)"
    )
    passed = (
        f"(NOT {failed} AND 100 * {m}.covered_words <= {max_covered} * {m}.n_words"
        f" AND {m}.longest_repeat <= {max_repeat})"
    )
    order = [c for c in docs.columns if c in kept]
    return measured.selectExpr(
        *(f"`{c}`" for c in order),
        f"named_struct({', '.join(f"'{n}', {m}.{n}" for n in Measures._fields)},"
        f" 'base_failed', {failed}, 'kept', {passed}) AS `{to}`",
    )


def repetition_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int
) -> DataFrame:
    """(id, the seven measures, base_failed, kept) for each row."""
    judged = with_quality(
        docs.select(id_col, text_col), "quality", text_col=text_col, keep_text=False, **limits
    )
    return judged.select(id_col, "quality.*")
