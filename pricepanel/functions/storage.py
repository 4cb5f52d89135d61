"""Folder that driver and executors share, and tables cut off from their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession


#: Paths that were handed out, by application.
_HANDED_OUT: dict[str, list[str]] = defaultdict(list)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder becomes it in local mode, as in tests; a cluster's executors would not see the
    driver's temporary folder, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="pricepanel-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _HANDED_OUT[spark.sparkContext.applicationId].append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Deletes what this application wrote under its scratch paths, and tells how many there were.

    For the end of a job: results that were not saved elsewhere read those tables, so they can't be read again.
    """
    paths = _HANDED_OUT.pop(spark.sparkContext.applicationId, [])
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        found += path.getFileSystem(conf).delete(path, True)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs share it, and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
