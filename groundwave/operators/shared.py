"""The folder that driver and executors share, and where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI in spark.checkpoint.dir. Only a local master may leave that unset: it gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        path = _own[0]
    return f"{located(spark, path)}/{name}-{uuid.uuid4().hex}"


def located(spark: SparkSession, path: str) -> str:
    """The URI of a folder, made if it is not there, that tasks open without Spark: a path without a scheme lies in Spark's default
    file system, a mount (viewfs) where it points."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where)
    return re.sub(r"^(\w+):/(?!/)", r"\1:///", system.resolvePath(where).toString()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()
