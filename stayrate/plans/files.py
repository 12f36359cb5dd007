"""Small files and folders that the driver reads and writes through Spark's file systems."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir`` of the session; a temporary folder if it is a local one without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        return None
    name = spark.sparkContext.applicationId
    if name not in _local:
        _local[name] = f"file://{tempfile.mkdtemp(prefix='stayrate-')}"
    return _local[name]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    shared = shared_folder(spark)
    if shared is None:
        raise ValueError("pass a folder every executor can reach, or set spark.checkpoint.dir")
    return f"{shared}/stayrate-{name}-{uuid4().hex}"


def _store(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None if it is not there."""
    store, target = _store(spark, path)
    if not store.exists(target):
        return None
    stream = store.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, content: str) -> None:
    """Write a small file beside ``path`` and rename it over the old one, in one step.

    Readers see the old content or the new one. Stores that rename by copying give no such promise for
    the moment of the rename.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    draft_path = f"{path}.{uuid4().hex}"
    store, draft = _store(spark, draft_path)
    stream = store.create(draft, True)
    stream.write(bytearray(content.encode()))
    stream.close()
    fs = jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(
        store.makeQualified(draft).toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    over = gateway.new_array(getattr(fs, "Options$Rename"), 1)
    over[0] = getattr(fs, "Options$Rename").OVERWRITE
    context.rename(store.makeQualified(draft), store.makeQualified(fs.Path(path)), over)


def children(spark: SparkSession, path: str) -> list[tuple[str, str, int, bool]]:
    """(name, path, bytes, is a folder) of what a folder holds; empty if it is not there."""
    store, target = _store(spark, path)
    if not store.exists(target):
        return []
    return [
        (s.getPath().getName(), str(s.getPath()), s.getLen(), s.isDirectory())
        for s in store.listStatus(target)
    ]


def delete_folder(spark: SparkSession, path: str) -> None:
    store, target = _store(spark, path)
    store.delete(target, True)
