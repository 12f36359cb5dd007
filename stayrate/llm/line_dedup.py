"""Substring dedup by hashing lines and sentences: of equal units only the earliest one stays.

A text is cut into units at line feeds and after words that end in ``.``, ``!`` or ``?``, so that a
passage set into the middle of a line is seen too. A unit is normalised (A-Z lowered, white space
dropped between words) and hashed to 64 bits; equal digests are dealt together over the whole table,
the unit of smallest (id, number) stays, the others are marked. Consecutive marked units form a run,
and a run of at least ``min_words`` words is removed; shorter ones are left, as short lines repeat
in clean texts too. Removed byte ranges of the input text are returned.

Only digests are shuffled before the decision. Each slice of about a megabyte sends one row per
digest and marks its own repetitions, so a line found in a third of all texts fills no task.

A null text stays null and an empty one empty, both with no units. Rows without id, and rows whose
id occurs more than once, have no place in the order: they are returned as they are, with no removed
range, and cause no removal. All columns of the input are kept; a column named like the one added is
replaced. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.shared import packed, small_batches, unpacked, written
from stayrate.llm.text import LOWER, Texts, mix, run_hashes, text_slices, unit_hashes, words

MIN_WORDS = 8
ROWS_PER_TASK = 1_500_000
REMOVAL = (
    "n_units: bigint, n_removed: bigint, starts: array<bigint>, ends: array<bigint>,"
    " short_starts: array<bigint>, short_ends: array<bigint>"
)

_STOP = np.isin(np.arange(256), list(b".!?"))


class Units:
    """Units of the texts of a slice: number of words, first byte, text, digest of 128 bits.

    The halves of a digest, ``digest`` and ``check``, are independent. Of 10**13 different units, about
    as many as 100 TB of text hold, two share a digest with probability 2 * 10**-13.
    """

    def __init__(self, texts: Texts, digests: bool = True) -> None:
        found = words(texts)
        feeds = np.concatenate(([0], np.cumsum(texts.data == 10)))
        cut = np.ones(len(found.start) + 1, bool)
        if len(found.start):
            cut[1:-1] = (
                _STOP[texts.data[found.end[:-1] - 1]]
                | (feeds[found.start[1:]] > feeds[found.end[:-1]])
                | (found.text[1:] != found.text[:-1])
            )
        edges = np.flatnonzero(cut) if len(found.start) else np.zeros(1, np.int64)
        first, self.n_words = edges[:-1], np.diff(edges)
        self.start = found.start[first]
        self.text = found.text[first]
        # Number of the first unit of each text, and of all units.
        self.before = np.searchsorted(self.text, np.arange(texts.last - texts.first + 1))
        if digests:
            data = LOWER[texts.data]
            self.digest, self.check = (
                run_hashes(unit_hashes(data, found.start, found.end, seed), first, edges[1:], seed)
                for seed in (1, 2)
            )


def unit_rows(docs: DataFrame) -> DataFrame:
    """(deal, check, id, unit): ``unit`` holds number * 2 + 1 for a unit already seen in its slice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            ids = batch.column(0).to_numpy()
            for texts in text_slices(batch.column(1)):
                units = Units(texts)
                number = np.arange(len(units.text)) - units.before[units.text]
                owner = ids[texts.first + units.text]
                again = later(units.digest, units.check)
                deal = np.where(again, mix(owner.astype(np.uint64)), units.digest)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(deal.view(np.int64)),
                        pa.array(units.check.view(np.int64)),
                        pa.array(owner),
                        pa.array(number * 2 + again),
                    ],
                    names=["deal", "check", "id", "unit"],
                )

    return docs.select("id", "text").mapInArrow(
        cut, "deal bigint, check bigint, id bigint, unit bigint"
    )


def later(*values: np.ndarray) -> np.ndarray:
    """Marks rows of the given columns that occurred before, in the given order."""
    order = np.lexsort(values)
    out = np.zeros(len(order), bool)
    out[order[1:]] = np.logical_and.reduce([v[order][1:] == v[order][:-1] for v in values])
    return out


def marked_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, unit) of the units of a partition that an earlier one equals."""
    columns = [[c.to_numpy() for c in b.columns] for b in batches]
    if not columns:
        return
    deal, check, ids, unit = (np.concatenate(c) for c in zip(*columns))
    del columns
    known = unit % 2 == 1
    rest = np.flatnonzero(~known)
    rest = rest[np.lexsort((unit[rest], ids[rest]))]
    marked = np.concatenate((np.flatnonzero(known), rest[later(check[rest], deal[rest])]))
    for i in range(0, len(marked), 1 << 17):
        part = marked[i : i + (1 << 17)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[part]), pa.array(unit[part] // 2)], names=["id", "unit"]
        )


def removed_ranges(
    size: int, start: np.ndarray, n_words: np.ndarray, marks: np.ndarray, min_words: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the runs of marked units, up to the next unit, and which are long enough."""
    flag = np.zeros(len(start) + 2, bool)
    flag[1:-1][marks] = True
    first = np.flatnonzero(flag[1:] & ~flag[:-1])
    last = np.flatnonzero(flag[:-1] & ~flag[1:])
    count = np.concatenate(([0], np.cumsum(n_words)))
    long_ = count[last] - count[first] >= min_words
    ends = np.append(start, size)
    return start[first], ends[last], long_


def dedup_units(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    to: str = "removal",
) -> DataFrame:
    """``docs`` without repeated passages, and a struct ``to``: n_units, n_removed, starts, ends.

    ``n_removed`` counts bytes; ``starts`` and ``ends`` are byte offsets in the input text. Repeated
    runs below ``min_words`` words stay, as short lines repeat in clean texts by chance; their ranges
    are ``short_starts`` and ``short_ends``. With ``min_words`` 1 all repeats are removed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = docs.drop(to)
    others = [c for c in named.columns if c != text_col]

    slim = named.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"`{text_col}` AS text")
    odd = written(slim.groupBy("id").count().filter("count > 1 OR id IS NULL"), "line-odd")
    regular = not odd.isEmpty()
    if regular:
        slim = slim.filter("id IS NOT NULL").join(odd.select("id"), "id", "left_anti")
    total = slim.agg(F.expr("coalesce(sum(octet_length(text)), 0)")).first()[0]
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // 20 // ROWS_PER_TASK + 1
    )
    marks = (
        unit_rows(slim)
        .repartition(tasks, "deal")
        .mapInArrow(marked_units, "id bigint, unit bigint")
        .groupBy("id")
        .agg(F.collect_list("unit").alias("marks"))
    )
    # The other columns travel as one struct, so their names cannot clash.
    row = named.select(
        F.col(text_col).alias("text"),
        F.col(id_col).cast("bigint").alias("id"),
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"),
    )
    joined = packed(row, "text").join(marks, "id", "left")
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_text, out = [], []
            for first, column in unpacked(batch.column(0)):
                for texts in text_slices(column):
                    units = Units(texts, digests=False)
                    for i in range(texts.last - texts.first):
                        row = first + texts.first + i
                        lo, hi = units.before[i], units.before[i + 1]
                        begin, end = texts.offsets[i], texts.offsets[i + 1]
                        text = texts.data[begin:end].tobytes()
                        marked = batch.column(1)[row]
                        a = b = np.zeros(0, np.int64)
                        long_ = np.zeros(0, bool)
                        if marked.is_valid:
                            a, b, long_ = removed_ranges(
                                len(text),
                                units.start[lo:hi] - begin,
                                units.n_words[lo:hi],
                                marked.values.to_numpy(),
                                min_words,
                            )
                        short = a[~long_].tolist(), b[~long_].tolist()
                        a, b = a[long_], b[long_]
                        if len(a):
                            keep = np.concatenate(([0], b)), np.concatenate((a, [len(text)]))
                            text = b"".join(text[x:y] for x, y in zip(*keep))
                        valid = batch.column(0)[row].is_valid
                        out_text.append(text if valid else None)
                        out.append((hi - lo, int((b - a).sum()), a.tolist(), b.tolist(), *short))
            lists = pa.list_(pa.int64())
            kinds = {"n_units": pa.int64(), "n_removed": pa.int64()} | dict.fromkeys(
                ("starts", "ends", "short_starts", "short_ends"), lists
            )
            counts = list(zip(*out)) if out else [[]] * len(kinds)
            removal = pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip(counts, kinds.values())], list(kinds)
            )
            new_text = pa.array(out_text, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [new_text, batch.column(2), removal], names=["text", "row", "removal"]
            )

    row_type = joined.schema["row"].dataType.simpleString()
    done = joined.select("packed", "marks", "row").mapInArrow(
        rebuild, f"text string, row {row_type}, removal struct<{REMOVAL}>"
    )
    return done.select(
        *(F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in named.columns),
        F.col("removal").alias(to),
    )
