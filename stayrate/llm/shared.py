"""Tables in the shared folder, packed texts, first holders of a key, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    if context.applicationId not in _local:
        _local[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='stayrate-')}"
    return _local[context.applicationId]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole texts go to Python in batches of at most ``rows``, unless the session has a smaller limit."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, survives executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """:func:`written`, and the shuffles of the write are deleted at its end: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(_CLEANUP, before)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`written` that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_written(df: DataFrame) -> None:
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        delete_path(df.sparkSession, path)


def packed(docs: DataFrame, text_col: str, to: str = "packed") -> DataFrame:
    """``docs`` with the text column replaced by the compressed text ``to``, for a shuffle.

    Null texts stay null.
    """
    others = [c for c in docs.columns if c != text_col]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            values = [
                tool.compress(text.as_buffer()) if text.is_valid else None
                for text in batch.column(0)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(values, pa.binary())], names=[*others, to]
            )

    return docs.select(text_col, *others).mapInArrow(pack, ", ".join([*fields, f"`{to}` binary"]))


def unpacked(column: pa.Array, max_bytes: int = 1 << 23) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a packed column as (row of the first text, texts as binary)."""
    tool = zstandard.ZstdDecompressor()
    texts: list[bytes | None] = []
    first = size = 0
    for value in column:
        text = tool.decompress(value.as_buffer()) if value.is_valid else None
        texts.append(text)
        size += len(text or b"")
        if size >= max_bytes:
            yield first, pa.array(texts, pa.large_binary())
            first, size, texts = first + len(texts), 0, []
    if texts:
        yield first, pa.array(texts, pa.large_binary())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for all ends of ``edges`` (a, b); component is the smallest node reached.

    Each round maps every node to the neighbour of lowest priority (a hash of the id, so that
    chains shrink by a constant factor) and contracts the edges. Rounds are written to the shared
    folder; only their row counts reach the driver. Loops and repeated edges are allowed.
    """

    def rank(c: str) -> str:
        return f"struct(xxhash64({c}) AS h, {c} AS id)"

    edges = edges.select("a", "b").filter("a <> b").distinct()
    edges = settled(edges, f"{name}-edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        best = both.groupBy("a").agg(
            F.expr(f"least(min({rank('b')}), min({rank('a')}))").alias("best")
        )
        step = settled(best.selectExpr("a AS node", "best.id AS parent"), f"{name}-step")
        steps.append(step)
        smaller = (
            edges.join(step.selectExpr("node AS a", "parent AS pa"), "a")
            .join(step.selectExpr("node AS b", "parent AS pb"), "b")
            .filter("pa <> pb")
            .selectExpr("least(pa, pb) AS a", "greatest(pa, pb) AS b")
            .distinct()
        )
        smaller = settled(smaller, f"{name}-edges")
        drop_written(edges)
        edges = smaller
    if not steps:
        return edges.selectExpr("a AS node", "b AS component")
    label = steps[-1].selectExpr("node", "parent AS root")
    for step in reversed(steps[:-1]):
        up = label.selectExpr("node AS parent", "root")
        label = step.join(up, "parent", "left").selectExpr(
            "node", "coalesce(root, parent) AS root"
        )
    smallest = label.groupBy("root").agg(
        F.expr("least(min(node), min(root))").alias("component")
    )
    return label.join(smallest, "root").select("node", "component")
