"""Streams of ticks: bars of closed windows, duplicates dropped, states by symbol, and cycles by batch.

Event time is ts. What is later than the watermark is dropped, and a window is given once, when the watermark has passed its end: an unfinished last bar is never seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY = "1 minute"


def ticks(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """symbol, ts, price, qty, maker, seq from a growing folder of events, or from one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        e = reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    else:
        e = reader.parquet(path)
    qty = 1 + F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    return e.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), qty.alias("qty"),
        (F.col("event_id") % 2 == 0).alias("maker"), F.col("event_id").alias("seq")
    )


def distinct(stream: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """The first of rows with equal keys that come within the delay of each other."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def flow_bars(stream: DataFrame, width: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """symbol, ts, close, vol, ofi, ntr, ofi_norm of closed windows."""
    signed = F.when(F.col("maker"), -F.col("qty")).otherwise(F.col("qty"))
    marked = stream if stream.isStreaming is False else stream.withWatermark("ts", delay)
    bars = marked.groupBy(F.window("ts", width).alias("w"), "symbol").agg(
        F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("qty").alias("vol"), F.sum(signed).alias("ofi"), F.count("*").alias("ntr")
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "close", "vol", "ofi", "ntr", F.try_divide("ofi", "vol").alias("ofi_norm"))


def hysteresis(stream: DataFrame, value: str, enter: float, leave: float) -> DataFrame:
    """symbol, ts, state: in beyond enter, out inside leave, else as before, a state kept for each symbol. Rows of one batch are taken in order of ts; a later batch goes on from there."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for x in rows[value]:
            if x == x:
                now = 1 if x > enter else -1 if x < -enter else 0 if abs(x) < leave else now
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"].to_numpy(), "state": out})

    return stream.select("symbol", "ts", value).groupBy("symbol").applyInPandasWithState(
        step, "symbol string, ts timestamp, state int", "state int", "append", GroupStateTimeout.NoTimeout
    )


def drained(stream: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into Parquet below place, and reads it: files already taken are not taken again when it is called with the same place."""
    run = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/rows").option(
        "checkpointLocation", f"{place}/log"
    ).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")


def cycles(stream: DataFrame, place: str, each: Callable[[DataFrame, DataFrame | None, int], DataFrame]) -> None:
    """each(batch, state, number) gives the next state, kept as a table per batch; a batch that is run again overwrites its own table, so that a lost one is made good."""
    spark = stream.sparkSession

    def once(batch: DataFrame, number: int) -> None:
        held = spark.read.parquet(f"{place}/state/{number - 1}") if number else None
        each(batch, held, number).write.mode("overwrite").parquet(f"{place}/state/{number}")

    stream.writeStream.foreachBatch(once).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
