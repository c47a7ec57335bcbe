"""Shared pieces: the scratch folder, table access and word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. It goes when the JVM ends.

    Where the setting is missing (tests, local mode) /tmp/checkpoints is used; a cluster without it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    path = f"{base.rstrip('/')}/riverbed-{uuid.uuid4().hex}"
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder whose tables are no longer read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes df to path and reads it again: lineage is cut, and a lost executor costs one table scan."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def runs(batches: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Runs of equal key; a run may go on in the next batch. Rows arrive sorted by key."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        k = pdf[key].to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        for a, b in zip(np.concatenate(([0], cut[:-1])) if len(cut) else [], cut, strict=True):
            yield pdf.iloc[a:b]
        rest = pdf.iloc[cut[-1] :] if len(cut) else pdf
    if rest is not None:
        yield rest
