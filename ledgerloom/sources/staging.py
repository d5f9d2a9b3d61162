"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no spark.checkpoint.dir, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or LOCAL_FALLBACK).rstrip("/")


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has the file system remove an intermediate folder when the session's process ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df to the shared folder and reads it back: plans stay small, and lost executors cost nothing done so far."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
