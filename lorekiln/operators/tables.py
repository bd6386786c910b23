"""Tables in the folder that driver and executors share: what later steps read again without making it anew."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_begun: set[str] = set()


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir; all of an application's go when it ends.

    Where the setting is unset, a local master gets a temporary folder; on a cluster that is an error, since executors and driver share no such folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "lorekiln-tables")
    run = f"{base.rstrip('/')}/lorekiln/{sc.applicationId}-tables"
    if run not in _begun:
        at = spark._jvm.org.apache.hadoop.fs.Path(run)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(at)
        store.deleteOnExit(at)
        _begun.add(run)
    return f"{run}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df as a table: a lost executor costs one read, and nothing below is worked out twice."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
