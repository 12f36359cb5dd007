"""Packing into optimal length buckets: least padding, then batches within a token budget.

The histogram of all lengths is counted by Spark; lengths above 2 * ``EXACT`` share an entry with those
in the same of ``EXACT`` steps per power of two, so it has at most ``EXACT`` * 40 entries whatever the
table, and only these reach the driver, each with its number of texts, their total and their longest
length. Dynamic programming over it chooses at most ``buckets`` boundaries, each the longest length of
an entry, with the least padding, which is counted exactly. A text is padded to its bucket's boundary, and a batch holds as many texts as fit the
budget, one at least. Texts are numbered inside their bucket in the order of a hash of id and text, so
batches mix sources: counts per (bucket, cell of the hash) are summed up in two levels, so no window
spans a bucket, and a text's number follows from its cell's offset.

Length is the number of words (runs of characters other than ASCII white space) or a given column.
A null or empty text has length 0 and is in no batch: bucket, batch and padding are null. Rows that
repeat an id are packed each; rows without id too. Other columns are kept; columns named like a
result (n_tokens, bucket, batch, slot, padding) are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.shared import written

EXACT = 512
BUCKETS = 8
BUDGET = 32_768
CELL_ROWS = 512
CELLS_PER_GROUP = 256
RESULT = ("n_tokens", "bucket", "batch", "slot", "padding")


def n_words(text: str) -> str:
    """SQL text of the number of words of a column."""
    return (
        rf"CAST(regexp_count(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+') AS BIGINT)"
    )


def rounded(length: str) -> str:
    """SQL text: a length as it is up to ``EXACT``, above rounded up to 1 / ``EXACT`` of its power."""
    step = f"CAST(pow(2, floor(log2({length} - 1)) - {EXACT.bit_length() - 1}) AS BIGINT)"
    return f"if({length} <= {EXACT}, {length}, ceil({length} / {step}) * {step})"


def boundaries(
    lengths: np.ndarray, counts: np.ndarray, buckets: int, sums: np.ndarray | None = None
) -> list[int]:
    """Bucket boundaries with the least padding for a histogram in ascending order.

    ``lengths`` are the longest of each entry's texts, ``sums`` their lengths together where an entry
    holds several lengths. ``cost[j]`` is the least padding of the first ``j`` lengths with the buckets so far; one more
    bucket from ``i`` to ``j`` pads each of its texts to ``lengths[j - 1]``.
    """
    n = len(lengths)
    count = np.concatenate(([0], np.cumsum(counts))).astype(float)
    sums = counts * lengths if sums is None else sums
    total = np.concatenate(([0], np.cumsum(sums))).astype(float)
    cost = np.concatenate(([0.0], np.full(n, np.inf)))
    choice = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        for j in range(1, n + 1):
            padding = (count[j] - count[:j]) * lengths[j - 1] - (total[j] - total[:j])
            options = cost[:j] + padding
            cut[j] = int(np.argmin(options))
            new[j] = options[cut[j]]
        cost = new
        choice.append(cut)
    out, j = [], n
    for cut in reversed(choice):
        if j > 0:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def pack_batches(
    docs: DataFrame,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    length: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without the text, and n_tokens, bucket (boundary), batch, slot and padding.

    ``batch`` numbers the batches of a bucket from 0, ``slot`` the texts of a batch.
    """
    others = [c for c in docs.columns if c != text_col and c not in RESULT]
    size = n_words(f"`{text_col}`") if length is None else f"CAST({length} AS BIGINT)"
    # The other columns travel as one struct, so their names cannot clash.
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.expr(size).alias("n_tokens"),
        F.xxhash64(id_col, text_col).alias("hash"),
    )
    sized = written(sized, "pack-sized")
    histogram = (
        sized.filter("n_tokens > 0")
        .groupBy(F.expr(rounded("n_tokens")).cast("bigint").alias("entry"))
        .agg(
            F.max("n_tokens").alias("length"),
            F.count("*").alias("n"),
            F.sum("n_tokens").alias("total"),
        )
        .orderBy("entry")
        .collect()
    )
    lengths, counts, sums = (
        np.array([row[c] for row in histogram], np.int64) for c in ("length", "n", "total")
    )
    edges = boundaries(lengths, counts, buckets, sums)
    cells = int(counts.sum()) // CELL_ROWS + 1
    bucket = "CASE " + " ".join(f"WHEN n_tokens <= {e} THEN {e}L" for e in edges) + " END"
    placed = sized.withColumn(
        "bucket", F.expr(f"if(n_tokens > 0, {bucket}, NULL)" if edges else "CAST(NULL AS BIGINT)")
    ).withColumn("cell", F.expr(f"pmod(hash, {cells}L)"))

    per_cell = placed.filter("bucket IS NOT NULL").groupBy("bucket", "cell").agg(
        F.count("*").alias("n")
    )
    per_cell = written(
        per_cell.withColumn("group", F.expr(f"cell div {CELLS_PER_GROUP}")), "pack-cells"
    )
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    groups = (
        per_cell.groupBy("bucket", "group")
        .agg(F.sum("n").alias("n"))
        .selectExpr(
            "bucket",
            "group",
            f"coalesce(sum(n) OVER (PARTITION BY bucket ORDER BY group {before}), 0) AS base",
        )
    )
    offsets = per_cell.join(groups, ["bucket", "group"]).selectExpr(
        "bucket",
        "cell",
        "base + coalesce(sum(n) OVER"
        f" (PARTITION BY bucket, group ORDER BY cell {before}), 0) AS offset",
    )
    numbered = placed.withColumn(
        "number",
        F.expr("row_number() OVER (PARTITION BY bucket, cell ORDER BY hash, id, n_tokens) - 1"),
    ).join(offsets, ["bucket", "cell"], "left")
    fit = f"greatest(1, {budget} div bucket)"
    return numbered.selectExpr(
        *(f"row.`{c}` AS `{c}`" for c in others),
        "n_tokens",
        "bucket",
        f"(offset + number) div {fit} AS batch",
        f"(offset + number) % {fit} AS slot",
        "bucket - n_tokens AS padding",
    )
