"""Session builder and the few settings the library depends on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "larkspur", **conf: str) -> SparkSession:
    """A session with a UTC clock and adaptive execution; ``conf`` uses ``__`` for ``.``.

    On a cluster, leave ``master`` unset and let spark-submit decide; partition counts are
    then taken from the cluster's own settings.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="larkspur-shared-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
