"""Where a query may write files that executors read: the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in spark.checkpoint.dir, removed when the driver's Python ends; where that is unset a local master gets the temporary
    folder, a cluster raises ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder: executors and driver of a cluster need a shared one")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/nearwell-{uuid.uuid4().hex}-{label}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM is gone already: nothing is left to do
        return
