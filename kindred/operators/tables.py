"""Tables that operators write on their way, in the folder that driver and executors share.

A written table ends lineage and is computed once, however many branches read it. Tables go with drop_table() once
nothing reads them again, those made within a scope() when it ends, and the rest when the application ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Of an Arrow batch that a Python worker gets.
BATCH_BYTES = 2 << 20

_SCOPES: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is set and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set, so executors share no folder for tables")
        root = tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read them back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kindred/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    for held in _SCOPES.get()[-1:]:
        held.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by cut(), once nothing reads it again."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        fs, at = _file_system(df.sparkSession, folder)
        fs.delete(at, True)


@contextmanager
def scope() -> Iterator[None]:
    """Tables that cut() makes inside go when the block ends: for long-lived sessions that have taken their rows by then.
    Of nested scopes the inner one has the table."""
    held: list[tuple[SparkSession, str]] = []
    token = _SCOPES.set((*_SCOPES.get(), held))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for spark, path in held:
            fs, at = _file_system(spark, path)
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)


def bounded(spark: SparkSession) -> None:
    """Hold Arrow batches of the session to BATCH_BYTES, or to less if the session says so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    spark.conf.set(name, str(min(BATCH_BYTES, now) if now > 0 else BATCH_BYTES))
