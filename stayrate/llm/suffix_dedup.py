"""Suffix-array dedup: remove every byte covered by a long enough string that also starts earlier.

Prefix doubling sorts positions by the rank of growing prefixes and lets go of positions whose rank
is unique. Ranking every byte of a corpus moves many times its size in each round, so positions are
first made sparse without loss, and prefixes grow from ``length`` // 3 to ``length`` at once:

1. A string of ``length`` bytes owns the position of its smallest ``length`` // 3-byte rank (a
   fingerprint): equal strings own the same position, so one position in about 35 bytes stands for
   all strings around it. Positions are dealt by rank; those whose rank is unique leave.
2. Around the positions that stay, the strings they own are ranked at full length. Each slice of
   texts first lets go of its own later occurrences and sends one copy of each string, as one
   context per position, dealt by the short rank. There all but the first occurrence are removed.
3. Removed ranges are put together per document.

The slices' own pass is the pre-aggregation that keeps a string found in a third of all documents
from filling one task: it arrives once per slice of about a megabyte.

Order is by id, then by start. A null or empty text has no bytes. Rows that repeat id and text are
the same document and get the same result. Of rows that repeat an id with other texts, only the one
with the smallest SHA-256 takes part; the others, and rows without id, lose nothing and cause
nothing. Other columns are ignored. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.shared import packed, small_batches, unpacked, written
from stayrate.llm.text import (
    Texts,
    mix,
    sliding_hashes,
    span_hashes,
    text_slices,
)

_PIECE = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
ROWS_PER_TASK = 1_500_000
WINDOWS_PER_PASS = 2_000_000


class Owners(NamedTuple):
    """Strings of one piece of a slice: their starts, the positions they own, the short ranks."""

    start: np.ndarray
    owner: np.ndarray
    rank: np.ndarray


def owners(texts: Texts, length: int) -> Iterator[Owners]:
    """All strings of ``length`` bytes inside one text each, with the position each one owns."""
    short = max(length // 3, 1)
    whole = np.ones(len(texts.data), bool)
    for begin, end in zip(texts.offsets[:-1], texts.offsets[1:]):
        whole[max(begin, end - length + 1) : end] = False
    for at in range(0, len(texts.data) - length + 1, _PIECE):
        data = texts.data[at : at + _PIECE + length - 1]
        ranks = sliding_hashes(data, short)
        least = (ranks & ~_LOW) | np.arange(len(ranks), dtype=np.uint64)
        width, have = length - short + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        start = np.flatnonzero(whole[at : at + len(least)])
        owner = (least[start] & _LOW).astype(np.int64)
        yield Owners(start + at, owner + at, ranks[owner])


def positions(docs: DataFrame, length: int) -> DataFrame:
    """(deal, id, pos): owned positions, dealt by rank; ``pos`` holds position * 4 + state.

    State 0: the only occurrence in its slice; 1: the first of several; 2: a later one, already
    known to be shared and dealt by id.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for texts in text_slices(batch.column(1), _PIECE):
                for piece in owners(texts, length):
                    if not len(piece.start):
                        continue
                    # Strings in a row own ascending positions, except across texts.
                    change = np.concatenate(([True], piece.owner[1:] != piece.owner[:-1]))
                    spot, rank = piece.owner[change], piece.rank[change]
                    row = np.searchsorted(texts.offsets, spot, "right") - 1
                    place = spot - texts.offsets[row]
                    owner = ids[texts.first + row]
                    order = np.argsort(rank, kind="stable")
                    same = np.concatenate(([False], rank[order][1:] == rank[order][:-1]))
                    state = np.where(same, 2, 0)
                    state[:-1][same[1:] & ~same[:-1]] = 1
                    states = np.empty(len(order), np.int64)
                    states[order] = state
                    deal = np.where(states == 2, mix(owner.astype(np.uint64)), rank)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(deal.view(np.int64)),
                            pa.array(owner),
                            pa.array(place * 4 + states),
                        ],
                        names=["deal", "id", "pos"],
                    )

    return docs.mapInArrow(find, "deal bigint, id bigint, pos bigint")


def shared_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, pos) of the positions of a partition whose rank is not unique."""
    columns = [[c.to_numpy() for c in b.columns] for b in batches]
    if not columns:
        return
    deal, ids, pos = (np.concatenate(c) for c in zip(*columns))
    del columns
    order = np.argsort(deal)
    deal = deal[order]
    begin = np.concatenate(([True], deal[1:] != deal[:-1]))
    end = np.concatenate((begin[1:], [True]))
    keep = order[~(begin & end)]
    alone = order[begin & end]
    keep = np.concatenate((keep, alone[pos[alone] % 4 > 0]))
    for i in range(0, len(keep), 1 << 17):
        part = keep[i : i + (1 << 17)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[part]), pa.array(pos[part] // 4)], names=["id", "pos"]
        )


def _later(values: np.ndarray) -> np.ndarray:
    """Marks values that occurred before, in the given order."""
    order = np.argsort(values, kind="stable")
    out = np.zeros(len(values), bool)
    out[order[1:]] = values[order][1:] == values[order][:-1]
    return out


def _ranges(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs in which the first column grows by 1, the others not."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = columns[0][1:] != columns[0][:-1] + 1
    for column in columns[1:]:
        cut |= column[1:] != column[:-1]
    return np.flatnonzero(np.concatenate(([True], cut))), np.flatnonzero(
        np.concatenate((cut, [True]))
    )


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) + np.repeat(start - before, size)]


def _contexts(length: int):
    """(deal, id, start, until, context): strings to rank, or ranges removed within a slice."""

    def rows(deal, ids, start, until, context, size) -> pa.RecordBatch:
        n = len(ids)
        if context is None:
            binary = pa.nulls(n, pa.binary())
        else:
            where = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            binary = pa.Array.from_buffers(
                pa.binary(), n, [None, pa.py_buffer(where), pa.py_buffer(context)]
            )
        return pa.RecordBatch.from_arrays(
            [pa.array(deal.view(np.int64)), pa.array(ids), pa.array(start), pa.array(until), binary],
            names=["deal", "id", "start", "until", "context"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            ids = batch.column(0).to_numpy()
            for first, column in unpacked(batch.column(1), _PIECE):
                for texts in text_slices(column, _PIECE):
                    at = first + texts.first
                    stays = np.zeros(len(texts.data), bool)
                    for i in range(texts.last - texts.first):
                        begin, end = texts.offsets[i], texts.offsets[i + 1]
                        spots = batch.column(2)[at + i].values.to_numpy()
                        stays[begin + spots[spots < end - begin]] = True
                    for piece in owners(texts, length):
                        open_ = stays[piece.owner]
                        start, owner, rank = (c[open_] for c in piece)
                        if not len(start):
                            continue
                        later = _later(span_hashes(texts.data, start, start + length))
                        row = np.searchsorted(texts.offsets, start, "right") - 1
                        place = start - texts.offsets[row]
                        owned = ids[at + row]
                        a, b = _ranges(start[later], row[later])
                        if len(a):
                            who, spot = owned[later], place[later]
                            yield rows(
                                mix(who[a].astype(np.uint64)), who[a], spot[a],
                                spot[b] + length, None, None,
                            )
                        new = ~later
                        a, b = _ranges(start[new], row[new], owner[new])
                        if len(a):
                            size = start[new][b] - start[new][a] + length
                            yield rows(
                                rank[new][a], owned[new][a], place[new][a],
                                np.full(len(a), -1), _gather(texts.data, start[new][a], size), size,
                            )

    return cut


def _removed(length: int):
    """(id, start, until) of all but the first occurrences among the contexts of a partition."""

    def ranges(ids, start, until) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(start), pa.array(until)], names=["id", "start", "until"]
        )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            known = batch.column(3).to_numpy() >= 0
            if known.any():
                yield ranges(*(batch.column(i).to_numpy()[known] for i in (1, 2, 3)))
            if not known.all():
                kept.append(batch.filter(pa.array(~known)))
        if not kept:
            return
        table = pa.Table.from_batches(kept).combine_chunks()
        deal, ids, start = (table.column(i).to_numpy() for i in range(3))
        texts = table.column(4).combine_chunks().cast(pa.large_binary())
        del kept, table
        where = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(ids) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        size = np.diff(where)
        order = np.lexsort((start, ids))
        passes = int((size - length + 1).sum()) // WINDOWS_PER_PASS + 1
        bucket = mix(deal.view(np.uint64)) % np.uint64(passes)
        for number in range(passes):
            mine = order[bucket[order] == number]
            if not len(mine):
                continue
            content = _gather(data, where[mine], size[mine])
            strings = size[mine] - length + 1
            row = np.repeat(np.arange(len(mine)), strings)
            within = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
            begin = (np.cumsum(size[mine]) - size[mine])[row] + within
            later = _later(span_hashes(content, begin, begin + length))
            a, b = _ranges(within[later], row[later])
            if len(a):
                spot = start[mine][row[later]] + within[later]
                yield ranges(ids[mine][row[later]][a], spot[a], spot[b] + length)

    return settle


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal runs; ranges that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((new[1:], [True]))]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for first, texts in unpacked(batch.column(1)):
            for i, text in enumerate(texts.to_pylist(), first):
                spans = batch.column(2)[i].values
                starts, ends = merged(*(spans.field(f).to_numpy() for f in ("start", "until")))
                keep = hashlib.sha256()
                done = 0
                for a, b in zip(starts.tolist(), ends.tolist()):
                    keep.update(text[done:a])
                    done = b
                keep.update(text[done:])
                out.append((starts.tolist(), ends.tolist(), keep.hexdigest()))
        starts, ends, digest = zip(*out)
        removed = [sum(b) - sum(a) for a, b in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(removed, pa.int64()),
                pa.array(starts, pa.list_(pa.int64())),
                pa.array(ends, pa.list_(pa.int64())),
                pa.array(digest),
            ],
            names=["id", "n_removed", "starts", "ends", "kept_sha256"],
        )


def remove_repeats(
    docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends).

    ``starts`` and ``ends`` are the byte offsets of the removed runs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    base = written(
        docs.selectExpr("id", "octet_length(text) AS n_bytes", "sha2(text, 256) AS digest"),
        "suffix-base",
    )
    repeated = base.groupBy("id").count().filter("count > 1 OR id IS NULL")
    work = docs
    if not repeated.isEmpty():
        chosen = base.filter("id IS NOT NULL").groupBy("id").agg(F.min("digest").alias("digest"))
        odd = docs.join(repeated.select("id"), "id", "left_semi").filter("id IS NOT NULL")
        odd = odd.withColumn("digest", F.sha2("text", 256)).join(chosen, ["id", "digest"])
        one = odd.dropDuplicates(["id"]).select("id", "text")
        usual = docs.filter("id IS NOT NULL").join(repeated.select("id"), "id", "left_anti")
        work = usual.select("id", "text").union(one)
    total = int(base.agg(F.expr("coalesce(sum(n_bytes), 0)")).first()[0])
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    density = max(1, (length - max(length // 3, 1)) // 2)

    spots = (
        positions(work.filter(f"octet_length(text) >= {length}"), length)
        .repartition(max(shuffled, total // density // ROWS_PER_TASK + 1), "deal")
        .mapInArrow(shared_positions, "id bigint, pos bigint")
        .groupBy("id")
        .agg(F.collect_list("pos").alias("spots"))
    )
    texts = packed(work, "text")
    ranges = (
        texts.join(spots, "id")
        .select("id", "packed", "spots")
        .mapInArrow(
            _contexts(length),
            "deal bigint, id bigint, start bigint, until bigint, context binary",
        )
        .repartition(max(shuffled, total // (1 << 25) + 1), "deal")
        .mapInArrow(_removed(length), "id bigint, start bigint, until bigint")
    )
    spans = ranges.groupBy("id").agg(F.collect_list(F.struct("start", "until")).alias("spans"))
    changed = (
        texts.join(spans, "id")
        .select("id", "packed", "spans")
        .mapInArrow(
            _kept,
            "id bigint, n_removed bigint, starts array<bigint>, ends array<bigint>, kept_sha256 string",
        )
    )
    if work is not docs:
        changed = changed.join(chosen, "id")
    else:
        changed = changed.withColumn("digest", F.lit(None).cast("string"))
    return (
        base.join(changed.withColumnRenamed("digest", "of"), "id", "left")
        .withColumn("hit", F.expr("n_removed IS NOT NULL AND (of IS NULL OR of = digest)"))
        .selectExpr(
            f"id AS `{id_col}`",
            "CAST(n_bytes AS BIGINT) AS n_bytes",
            "if(hit, n_removed, 0L) AS n_removed",
            "if(hit, CAST(size(starts) AS BIGINT), 0L) AS n_spans",
            "if(hit, kept_sha256, digest) AS kept_sha256",
            "if(hit, starts, array()) AS starts",
            "if(hit, ends, array()) AS ends",
        )
    )
