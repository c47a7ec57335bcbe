"""Tables that are built once: read if they are there, else made and kept."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode, where none is set, one below /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


def place(spark: SparkSession) -> str:
    """A new folder there, which goes when the JVM ends."""
    path = f"{shared(spark)}/riverbed-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df written to a new folder and read again: for what an iteration reads many times, since a lost executor then costs one scan."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def name(tag: str) -> str:
    """Sixteen hexadecimal digits of a tag."""
    return hashlib.md5(tag.encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, tag: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a tag below root. An empty one is not kept, so that it is tried again; a half-written one has no mark of success and is made anew."""
    path = f"{root.rstrip('/')}/{name(tag)}.parquet"
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        made = build()
        made.write.mode("overwrite").parquet(path)
        kept = spark.read.schema(made.schema).parquet(path)
        if kept.isEmpty():
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
            return spark.createDataFrame([], made.schema)
        return kept
    return spark.read.parquet(path)
