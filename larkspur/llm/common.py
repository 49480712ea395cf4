"""What the training-data operators share: input tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few fixed-width columns up to which a table is broadcast; each takes under 100 bytes.
BROADCAST_ROWS = 500_000


def few(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has no more than BROADCAST_ROWS; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; on a cluster that is an error, for executors would not see it.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="larkspur-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at)
    return at.rstrip("/")


_watching: list[list[str]] = []


@contextmanager
def made_paths():
    """A list of the paths that fresh_path() gives out inside, in order; for one thread."""
    _watching.append([])
    try:
        yield _watching[-1]
    finally:
        _watching.pop()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _watching:
        paths.append(path)
    return path


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Writes inside leave no shuffle files behind: what they wrote is read instead."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    with dropping_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of fresh_path() by Spark's own file system layer."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that a table does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
