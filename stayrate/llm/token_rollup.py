"""Token counts: additive totals by source, language and tokenizer, kept up to date by deltas.

A change of the corpus is a batch of signed rows: an insert adds a text and its tokens, a delete
takes both away, a revision adds the difference of two counts. Each batch is reduced to one row per
(source, lang, tokenizer) and written below ``batches/<id>``; it counts from the moment its marker
``commits/<id>`` exists, which names the attempt that counts. Committing an id again does nothing; each
writer of a batch writes an attempt of its own, ``batches/<id>/<attempt>``, so one that dies, or a
second writer of the same id, leaves what is committed as it is, and a batch counts once whatever is
run again. Only one writer's marker can take the place where the store renames exclusively, as HDFS
does; on object stores a batch id must have one writer at a time. Totals are the sum of all committed
batches, plus the newest snapshot made by :func:`compact`.

Only the per-key sums of a batch are shuffled, after a partial sum per task, so a source that holds
most rows fills no task. Null source or language is a key of its own. A null or empty text counts as
a text with 0 tokens. Rows that repeat an id count each, as does a row without id. A null sign,
count or tokenizer is an error. Keys whose totals are all 0 are left out.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING
from uuid import uuid4

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.llm.packing import n_words
from stayrate.llm.shared import small_batches

if TYPE_CHECKING:
    import tiktoken

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

# Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_LONG_RUN = 1000
_RUN = re.compile(
    rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{_LONG_RUN},}}"
)


def with_words(docs: DataFrame, to: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the number of words (not ASCII white space)."""
    return docs.withColumn(to, F.expr(n_words(f"`{text_col}`")))


def n_tokens(tool: tiktoken.Encoding, text: str) -> int:
    """Number of tokens; long runs of white space are cut first, as the pattern would cut them.

    The pattern's look-ahead overflows the stack on a run of a million. It takes a run less its last
    character as one piece, and at the end of a text all of it.
    """
    if len(text) < _LONG_RUN or not (runs := list(_RUN.finditer(text))):
        return len(tool.encode_ordinary(text))
    total = begin = 0
    for run in runs:
        last = run.end() if run.end() == len(text) else run.end() - 1
        total += len(tool.encode_ordinary(text[begin : run.start()]))
        total += len(tool._encode_single_piece(text[run.start() : last]))
        begin = last
    return total + len(tool.encode_ordinary(text[begin:]))


def with_bpe(docs: DataFrame, to: str, ranks_path: str, text_col: str = "text") -> DataFrame:
    """The other columns and the number of byte-level BPE tokens of each text.

    ``ranks_path`` names a file of base64 tokens and ranks, read on the driver and sent along.
    """
    small_batches(docs.sparkSession)
    with open(ranks_path, "rb") as file:
        content = file.read()
    others = [c for c in docs.columns if c not in (text_col, to)]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        tool = tiktoken.Encoding(
            "bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        for batch in batches:
            counts = [n_tokens(tool, t.as_py()) if t.is_valid else 0 for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(counts, pa.int64())], names=[*others, to]
            )

    return docs.select(text_col, *others).mapInArrow(count, ", ".join([*fields, f"`{to}` bigint"]))


def inserted(docs: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    return _signed(docs, tokenizer, "1L", f"`{tokens}`")


def deleted(docs: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    return _signed(docs, tokenizer, "-1L", f"-`{tokens}`")


def revised(docs: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    return _signed(docs, tokenizer, "0L", f"`{new}` - `{old}`")


def _signed(docs: DataFrame, tokenizer: str, docs_: str, tokens: str) -> DataFrame:
    name = tokenizer.replace("'", "''")
    return docs.selectExpr(
        "CAST(source AS STRING) AS source",
        "CAST(lang AS STRING) AS lang",
        f"'{name}' AS tokenizer",
        f"{docs_} AS n_docs",
        f"CAST({tokens} AS BIGINT) AS n_tokens",
    )


class Rollup:
    """The batches, commits and snapshots below one folder of a store that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        root = self._path("")
        self._store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in ("batches", "commits", "drafts", "snapshots"):
            self._store.mkdirs(self._path(name))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, folder: str) -> list[str]:
        found = self._store.listStatus(self._path(folder))
        return sorted(f.getPath().getName() for f in found)

    def committed(self) -> list[str]:
        return self._names("commits")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; False, and no work, if it is committed already."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id consists of letters, digits, - and _")
        if self._store.exists(self._path(f"commits/{batch}")):
            return False
        wrong = F.expr("tokenizer IS NULL OR n_docs IS NULL OR n_tokens IS NULL")
        changes.withColumn(
            "n_tokens", F.when(wrong, F.raise_error(F.lit("incomplete change"))).otherwise(F.col("n_tokens"))
        ).groupBy(*KEYS).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
        ).coalesce(1).write.parquet(f"{self.folder}/batches/{batch}/{(attempt := uuid4().hex)}")
        return self._mark(batch, attempt)

    def _mark(self, batch: str, attempt: str) -> bool:
        """Put the marker in place whole; False if another writer's is there."""
        marker, draft = self._path(f"commits/{batch}"), self._path(f"drafts/{attempt}")
        stream = self._store.create(draft, True)
        stream.write(bytearray(attempt.encode()))
        stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        draft, marker = self._store.makeQualified(draft), self._store.makeQualified(marker)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        once = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, marker, once)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            return False
        return True

    def _attempt(self, batch: str) -> str:
        stream = self._store.open(self._path(f"commits/{batch}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _snapshot(self) -> tuple[str | None, list[str]]:
        """The newest complete snapshot and the batches it holds."""
        for name in reversed(self._names("snapshots")):
            if self._store.exists(self._path(f"snapshots/{name}/held/_SUCCESS")):
                held = self.spark.read.json(
                    f"{self.folder}/snapshots/{name}/held", schema="held array<string>"
                )
                return name, held.first()["held"]
        return None, []

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        name, held = self._snapshot()
        done = set(held)
        paths = [
            f"{self.folder}/batches/{b}/{self._attempt(b)}" for b in self.committed() if b not in done
        ]
        if name is not None:
            paths.append(f"{self.folder}/snapshots/{name}/totals")
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return (
            self.spark.read.schema(SCHEMA)
            .parquet(*paths)
            .groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .filter("n_docs <> 0 OR n_tokens <> 0")
        )

    def compact(self) -> None:
        """Sum all committed batches up in a snapshot, so that totals read one table."""
        batches = self.committed()
        name = f"{len(self._names('snapshots')):08d}"
        base = f"{self.folder}/snapshots/{name}"
        self.totals().coalesce(1).write.mode("overwrite").parquet(f"{base}/totals")
        held = self.spark.createDataFrame([(json.dumps({"held": batches}),)], "value string")
        held.coalesce(1).write.mode("overwrite").text(f"{base}/held")
