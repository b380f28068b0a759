"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_folders: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir.

    Where that is unset, a local session (tests, one machine) gets a temporary
    folder that goes with the process; on any other master it is an error, for
    executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    made = f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(made)
    return made


def release(spark: SparkSession) -> int:
    """Delete all folders that this application has made, and tell how many; tables that were read from them are gone with them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    found = _folders.pop(spark.sparkContext.applicationId, [])
    for path in found:
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(found)


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: its lineage is cut, and lost executors cost nothing."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
