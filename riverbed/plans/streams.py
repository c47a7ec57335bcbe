"""Streams drained over the tables, and documents written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.plans.registry import query
from riverbed.plans.research import WITH_T
from riverbed.sinks import files
from riverbed.sources.cache import place
from riverbed.streaming import bars


@query(f"""{WITH_T}, b AS (SELECT symbol, date_trunc('minute', ts) AS ts, arg_max(price, (ts, seq)) AS close, sum(qty) AS vol, sum(CASE WHEN maker THEN -qty ELSE qty END) AS ofi, count(*) AS ntr FROM ticks GROUP BY 1, 2), m AS (SELECT max(ts) AS m FROM ticks)
SELECT symbol, ts, close, vol, ofi, ntr, ofi / vol AS ofi_norm FROM b, m WHERE ts + INTERVAL 1 MINUTE <= date_trunc('milliseconds', m) - INTERVAL 1 MINUTE""", "close vol ofi ofi_norm", "symbol ts ntr")
def stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Minute bars of a stream: those whose window the watermark has passed."""
    return bars.drained(bars.flow_bars(bars.ticks(spark, f"{sf}/events.parquet")), place(spark))


@query(f"""{WITH_T}
SELECT symbol, count(*) AS n, count(DISTINCT seq) AS distinct_n FROM ticks GROUP BY symbol""", "", "symbol n distinct_n")
def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks without those that come twice."""
    d = bars.drained(bars.distinct(bars.ticks(spark, f"{sf}/events.parquet"), ["symbol", "seq"]), place(spark))
    return d.groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("distinct_n"))


@query(f"""{WITH_T}
SELECT symbol, ts, seq, CAST(coalesce(last_value(CASE WHEN price - 250 > 100 THEN 1 WHEN price - 250 < -100 THEN -1 WHEN abs(price - 250) < 33 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) AS INTEGER) AS state FROM ticks""", "", "symbol ts state")
def stream_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    """A state by symbol that goes on from batch to batch."""
    t = bars.ticks(spark, f"{sf}/events.parquet").withColumn("x", F.col("price") - 250)
    return bars.drained(bars.hysteresis(t, "x", 100.0, 33.0), place(spark))


@query(f"""{WITH_T}, b AS (SELECT symbol, date_trunc('day', ts) AS ts, avg(price) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(price) END AS sd FROM ticks GROUP BY 1, 2)
SELECT symbol, ts, mean, sd FROM b""", "mean sd", "symbol ts")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A report written as strict JSON and read again: what is no number is null."""
    from riverbed.sources import panels as P

    b = P.ticks(spark, sf).groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(
        F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd")
    ).withColumnRenamed("day", "ts")
    where = place(spark)
    files.json_report(b, where)
    return files.read_report(spark, where, b.schema)


@query("""WITH q AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus, n, value FROM q""", "value:2", "o_orderpriority o_orderstatus n")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A table written as CSV with a header and read again under its schema."""
    from riverbed.sources import panels as P

    q = P.table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("value"))
    where = place(spark)
    files.csv_table(q, where)
    return spark.read.option("header", True).schema(q.schema).csv(where)
