"""The folder that driver and executors share, and tables that are materialised there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, as a URI or path; its checkpoints go there too.

    Where the session names none, a temporary folder serves a local master
    (tests, a plain shell).  On a cluster that raises: executors do not see a
    folder of the driver's machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='nearloom-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, as a URI; what is written there goes when the driver ends."""
    top = shared_dir(spark)
    if "://" not in top and not top.startswith("file:"):
        top = f"file://{os.path.abspath(top)}"
    path = f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{path}/data"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Like :func:`cut`, as compressed Parquet: for rows that are many or wide."""
    path = shared_path(df.sparkSession, what)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
