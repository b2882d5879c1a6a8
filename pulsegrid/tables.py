"""Tables between the steps of a plan, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a temporary folder, which only a local master can read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir is unset: with master {master} steps need a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str, long: bool = False) -> DataFrame:
    """Cut lineage by a written table; later reads survive lost executors, know its size and compute nothing again.

    The table goes when the driver's JVM ends, or with clear().  A long one is
    not sent to every executor by the join that reads it: files of samples are
    many times smaller than their rows, and an aggregate of them counts as large.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pulsegrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.hint("merge") if long else table


def clear(spark: SparkSession) -> int:
    """Delete the tables this application has written so far; call it when the results that read them have been written."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    return len(paths)
