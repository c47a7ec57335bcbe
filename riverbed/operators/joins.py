"""Alignment of panels: as-of, outer with zeros, lookups of checked size, windows that all streams live in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a lookup table that are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def asof(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """left with the values of the latest right row of the same keys at or before its ts; null before the first.

    One exchange by the keys: both sides are laid in a row and the last known values carried forward. A right row at the same ts counts. Of right rows with equal keys and ts
    any one counts, so they should be distinct. A left row is never lost or repeated.
    """
    cols = left.columns
    kind = {c: right.schema[c].dataType for c in values}
    seen = F.struct(*[F.col(c) for c in values])
    a = left.select(
        F.struct(*cols).alias("_row"), *keys, "ts", F.lit(1).alias("_side"),
        F.lit(None).cast(right.select(seen.alias("s")).schema["s"].dataType).alias("_seen")
    )
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *keys, "ts", F.lit(0).alias("_side"), seen.alias("_seen"))
    order = W.partitionBy(*keys).orderBy("ts", "_side").rowsBetween(W.unboundedPreceding, 0)
    known = a.unionByName(b).withColumn("_seen", F.last("_seen", True).over(order)).where("_side = 1")
    return known.select("_row.*", *[F.col("_seen")[c].cast(kind[c]).alias(c) for c in values])


def lookup(df: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Inner join with a dimension, which is broadcast only if it has been counted to be small."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(small) if few else small, on)


def outer_zero(streams: list[DataFrame], on: str, value: str) -> DataFrame:
    """on, total: the sum of the streams' values where any has one; a stream without a row counts as zero. A union with an aggregate, not a chain of full joins."""
    every = streams[0].select(on, value)
    for s in streams[1:]:
        every = every.unionByName(s.select(on, value))
    return every.groupBy(on).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("total"))


def common_window(streams: DataFrame, key: str) -> DataFrame:
    """The rows of streams (key, ts, ...) from the time at which the last of them begins until the first ends; bounds are one row."""
    span = streams.groupBy(key).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).agg(F.max("a").alias("_from"), F.min("b").alias("_to"))
    return streams.join(F.broadcast(span), F.expr("ts BETWEEN _from AND _to")).drop("_from", "_to")
