"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and everything runs in one process (tests)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="netsift-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from reliable storage from now on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def packed(df: DataFrame) -> Iterator[DataFrame]:
    """df, written once to the shared folder as Parquet, a fraction of a checkpoint's size; gone afterwards, so nothing lazy may leave the block."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/packed-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Lets go of finished steps: Spark deletes their shuffle files once the driver's objects for them are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
