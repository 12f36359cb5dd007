"""SQL texts of the expressions shared by the operators; all of them stay inside codegen.

Inputs are SQL texts too, so they nest; ``cols`` turns finished texts into columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def cols(*texts: str) -> list[Column]:
    return [F.expr(text) for text in texts]


def rnd(x: str, digits: int = 0) -> str:
    """Round half away from zero in double arithmetic.

    Spark's own ``round(x, n)`` rounds the printed decimal, which disagrees with engines that
    scale, round and unscale (0.285 at two digits).
    """
    if digits == 0:
        return f"round(CAST({x} AS DOUBLE), 0)"
    scale = f"{10**digits}D"
    return f"(round(CAST({x} AS DOUBLE) * {scale}, 0) / {scale})"


def ratio(a: str, b: str) -> str:
    """``a / b`` as double; NULL where ``b`` is 0."""
    return f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"


def pct(a: str, b: str, digits: int = 1) -> str:
    return rnd(f"try_divide(100D * ({a}), CAST({b} AS DOUBLE))", digits)


# A double below 2**72 is cut into six whole numbers, each of 24 bits, from 2**-72 up.
_LIMB_BITS = 24
_LIMB_PLACES = range(-3, 3)
_LIMB_LIMIT = f"{2.0**72!r}D"


def _limb(x: str, place: int) -> str:
    """The part of a double at ``place``: rounding at two places, so neither step is inexact."""

    def cut(at: int) -> str:
        return f"rint(CAST({x} AS DOUBLE) * {2.0 ** (-_LIMB_BITS * at)!r}D)"

    above = f" - {cut(place + 1)} * {2.0**_LIMB_BITS!r}D" if place < _LIMB_PLACES[-1] else ""
    return (
        f"CASE WHEN abs(CAST({x} AS DOUBLE)) < {_LIMB_LIMIT} THEN CAST({cut(place)}{above} AS BIGINT)"
        f" WHEN {x} IS NOT NULL THEN 0L END"
    )


def _beyond_limbs(x: str) -> str:
    """What the limbs leave of a double: bits below 2**-72, or all of a larger one, NaN and infinity."""
    low = -_LIMB_BITS * _LIMB_PLACES[0]
    kept = f"rint(CAST({x} AS DOUBLE) * {2.0**low!r}D) * {2.0**-low!r}D"
    return (
        f"CASE WHEN abs(CAST({x} AS DOUBLE)) < {_LIMB_LIMIT} THEN CAST({x} AS DOUBLE) - {kept}"
        f" ELSE CAST({x} AS DOUBLE) END"
    )


def _exact_sum_of_doubles(x: str) -> str:
    half, size = 1 << _LIMB_BITS - 1, 1 << _LIMB_BITS
    carried, parts = "", [f"sum({_beyond_limbs(x)})"]
    for place in _LIMB_PLACES:
        total = f"(sum({_limb(x, place)}){carried} + {half}L)"
        # Rests lie around zero, so the highest part that is not zero decides and nothing cancels.
        rest = f"(({total} & {size - 1}L) - {half}L)" if place < _LIMB_PLACES[-1] else f"({total} - {half}L)"
        parts.append(f"CAST({rest} AS DOUBLE) * {2.0 ** (_LIMB_BITS * place)!r}D")
        carried = f" + shiftright({total}, {_LIMB_BITS})"
    return " + ".join(parts)


def exact_sum(x: str) -> str:
    """The sum of a decimal or double column as double, whatever order the rows come in.

    Sums of doubles depend on the order in which partitions arrive, so a re-run after a lost executor
    may give other digits; sums of whole numbers and of decimals do not. A decimal is summed as it is.
    A double is cut without loss into whole numbers of 24 bits each, which are summed apart and joined
    at the end; a group may have 5 * 10**11 rows. Only values of 2**72 and more, and bits below
    2**-72, are summed as doubles, so NaN and infinity give what a plain sum gives.
    """
    decimal = f"typeof(sum({x})) LIKE 'decimal%'"  # folded, so only one of the sums is in the plan
    return f"if({decimal}, CAST(sum({x}) AS DOUBLE), {_exact_sum_of_doubles(x)})"


def exact_avg(x: str) -> str:
    return ratio(exact_sum(x), f"count({x})")


def day(d: date) -> str:
    return f"DATE'{d.isoformat()}'"


def month_of(d: str) -> str:
    return f"trunc({d}, 'month')"


def month_index(signup: str, used: str) -> str:
    """Calendar months between two days: 31 January to 1 February is 1."""
    return f"((year({used}) - year({signup})) * 12 + month({used}) - month({signup}))"


def month_bits(months: str) -> str:
    """Aggregate: a long with a bit for each whole number below 63 that occurs."""
    return f"bit_or(shiftleft(1L, CAST({months} AS INT)))"


def has_bit(bits: str, place: int | str) -> str:
    return f"(shiftright({bits}, {place}) & 1L = 1L)"


# Calendar months are kept as bits of eras of five years.
ERA = 60


def month_number(d: str) -> str:
    """Months since the start of the calendar."""
    return f"(year({d}) * 12 + month({d}) - 1)"


def months_of_era(era: str, bits: str) -> str:
    """Array of the first days of the months that an era's bits hold."""
    places = f"filter(sequence(0, {ERA - 1}), i -> {has_bit(bits, 'i')})"
    number = f"({era} * {ERA} + i)"
    first = f"make_date(CAST({number} div 12 AS INT), CAST({number} % 12 AS INT) + 1, 1)"
    return f"transform({places}, i -> {first})"


def text(value: str) -> str:
    """A string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def bucketize(x: str, edges: Sequence[int], labels: Sequence[str]) -> str:
    """Label right-closed bins; the last one is open and NULL stays NULL."""
    bins = " ".join(
        f"WHEN {x} <= {edge} THEN {text(label)}" for edge, label in zip(edges, labels)
    )
    return f"CASE {bins} WHEN {x} > {edges[-1]} THEN {text(labels[-1])} END"


def banded(labels: Sequence[str]) -> list[str]:
    """Prefix labels with A, B, C ... so that they sort in bin order."""
    return [f"{chr(ord('A') + i)} {label}" for i, label in enumerate(labels)]


def within(value: str, window: tuple[int | None, int]) -> str:
    """Inside a window of days, both ends included; no first day means no lower bound."""
    lo, hi = window
    return f"({value} <= {hi})" if lo is None else f"({value} BETWEEN {lo} AND {hi})"
