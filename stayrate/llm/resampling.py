"""Importance resampling towards a target: hashed n-gram features, weights, a draw without replacement.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lowered. On the UTF-8
bytes of a text one table of 256 bytes lowers letters and turns all other ASCII bytes into spaces,
and ``bytes.split`` yields the words. The CRC-32 of a word is the seed of that of the word with a
space and the next one, so n-grams are hashed without being joined. Features are all runs of 1 to
``n`` words, repeats counted; a feature's bucket is its CRC-32 modulo ``buckets``.

1. Counters add up the features of a slice of texts, folded into one row of buckets a task; Spark sums
   these over all texts of the corpus, and of the target.
2. A bucket's gain is ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))``; a text's
   weight the floored mean of its features' gains. Gains go to the tasks, one number a bucket.
3. A hash of seed and id gives each document a Gumbel variate; weight and variate make its score, and
   the highest scores among documents of ``min_words`` words are a weighted draw without replacement.
   Scores are sorted over all tasks by ranges, so ranks need no single task: a row's place in its
   range and the counts of the ranges before it give them.

A null or empty text has no features and weight 0. A row without id is hashed as an empty id and, at
equal scores, ranks behind ids; rows that repeat an id rank in the order of their texts' digests, and
equal rows one after the other. An empty target or corpus counts nothing; an empty table gives no
rows. Other columns are ignored. Memory follows the longest text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.shared import small_batches, written

BUCKETS = 10_000
SLICE_BYTES = 1 << 20

# Lowers A-Z, keeps digits, a-z and all bytes of other characters, blanks the rest.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def feature_hashes(found: list[bytes], n: int) -> Iterator[list[int]]:
    """CRC-32 of all runs of 1, 2, ... ``n`` words, each from that of the run without its last word."""
    seeds = list(map(zlib.crc32, found))
    yield seeds
    spaced = [b" " + word for word in found]
    for size in range(1, n):
        seeds = list(map(zlib.crc32, spaced[size:], seeds))
        yield seeds


def bucket_counts(rows: DataFrame, text_col: str, n: int, buckets: int) -> dict[int, int]:
    """Features per bucket over all texts; at most ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        counter: Counter[int] = Counter()

        def fold() -> None:
            hashes = np.fromiter(counter.keys(), np.int64, len(counter))
            np.add.at(total, hashes % buckets, np.fromiter(counter.values(), np.int64, len(counter)))
            counter.clear()

        held = 0
        for batch in batches:
            for text in batch.column(0):
                if not text.is_valid:
                    continue
                content = text.as_buffer().to_pybytes()
                for hashes in feature_hashes(words(content), n):
                    counter.update(hashes)
                held += len(content)
                if held >= SLICE_BYTES:
                    fold()
                    held = 0
        fold()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(total[used])], names=["bucket", "n"]
        )

    parts = rows.selectExpr(f"`{text_col}` AS text").mapInArrow(count, "bucket bigint, n bigint")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return {row["bucket"]: row["n"] for row in found}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln(ratio of smoothed shares)) per bucket."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    return np.array(
        [
            math.floor(
                1000
                * math.log(
                    ((target.get(b, 0) + 1) * (s_all + buckets))
                    / ((corpus.get(b, 0) + 1) * (t_all + buckets))
                )
            )
            for b in range(buckets)
        ],
        np.int64,
    )


def weighted(docs: DataFrame, gain: np.ndarray, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, digest) of each row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                content = text.as_buffer().to_pybytes() if text.is_valid else b""
                found = words(content)
                size = total = 0
                for hashes in feature_hashes(found, n):
                    size += len(hashes)
                    places = np.fromiter(hashes, np.int64, len(hashes)) % len(gain)
                    total += int(gain[places].sum())
                # Python's division of whole numbers goes down
                rows.append((len(found), size, total // size if size else 0, zlib.crc32(content)))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n_words", "n_features", "weight", "digest"],
            )

    rows = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(
        weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, digest bigint"
    )


def score(seed: int) -> str:
    """SQL text: the weight and a Gumbel variate from the hash of seed and id."""
    named = f"concat('{seed}:', coalesce(CAST(doc_id AS STRING), ''))"
    hashed = f"CAST(conv(substr(sha2({named}, 256), 1, 8), 16, 10) AS DOUBLE)"
    return f"weight + CAST(floor(-1000 * ln(-ln(({hashed} + 0.5D) / 4294967296D))) AS BIGINT)"


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the given total order, without a window over all of them.

    Only a count for each range of the sort passes through the driver.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id of a row in a sorted range is its place, with the number of the range above bit 33.
    placed = (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    placed = written(placed, "resample-placed").withColumn("range", F.shiftright("place", 33))
    counts = sorted(placed.groupBy("range").count().collect())
    before, starts = 0, []
    for number, count in counts:
        starts.append((number, before))
        before += count
    start = F.broadcast(spark.createDataFrame(starts, "range bigint, before bigint"))
    place = F.col("place").bitwiseAND((1 << 33) - 1)
    return (
        placed.join(start, "range")
        .withColumn("rank", F.col("before") + place + 1)
        .drop("range", "place", "before")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    min_words: int = 20,
    seed: int = 7,
    n: int = 2,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs``.

    ``rank`` is set for the ``percent`` of the documents of ``min_words`` words that are drawn.
    """
    small_batches(docs.sparkSession)
    gain = gains(
        bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets), buckets
    )
    rows = weighted(docs, gain, n, id_col, text_col).withColumn("score", F.expr(score(seed)))
    rows = written(rows, "resample-scores")
    fit = rows.filter(f"n_words >= {min_words}")
    drawn = percent * fit.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("digest"), F.asc("n_features")]
    places = ranked(fit, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = rows.filter(f"n_words < {min_words}").withColumn("rank", F.lit(None).cast("bigint"))
    return places.unionByName(others).drop("digest")
