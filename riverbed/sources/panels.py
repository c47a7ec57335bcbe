"""Long-format panels (symbol, ts, ...) built from the star-schema tables.

Prices are rounded to six decimals where they enter, so that sums in another order give the same panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Added before rounding, so that exact halves round alike in any engine.
NUDGE = 3.1e-10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, qty, maker, seq from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
        (1 + F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))).alias("qty"), (F.col("event_id") % 2 == 0).alias("maker"),
        F.col("event_id").alias("seq")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (date), close, high, low, qvol, spot, funding: one row per traded day."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("ts"))
        .agg(
            F.round(F.avg(px) + NUDGE, 6).alias("close"),
            F.round(F.max(px) + NUDGE, 6).alias("high"),
            F.round(F.min(px) + NUDGE, 6).alias("low"),
            F.round(F.sum("l_extendedprice") + NUDGE, 4).alias("qvol"),
            F.round(F.avg(px * (1 - F.col("l_discount"))) + NUDGE, 6).alias("spot"),
            F.round((F.avg("l_discount") - 0.05) / 100 + NUDGE / 100, 8).alias("funding"),
        )
    )


def weekly_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (part brand), ts (Monday), close, qvol."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_brand").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("ts")).agg(
        F.round(F.avg(px) + NUDGE, 6).alias("close"), F.round(F.sum("l_extendedprice") + NUDGE, 4).alias("qvol")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (date), open, high, low, close, volume, qvol, taker (bought by takers), trades, funding: one row per traded day."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    taker = F.sum(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")).otherwise(0.0))
    made = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("ts"))
        .agg(
            F.min_by(px, order).alias("open"),
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            F.max_by(px, order).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.round(F.sum("l_extendedprice") + NUDGE, 4).alias("qvol"),
            taker.alias("taker"),
            F.count("*").alias("trades"),
            F.round((F.avg("l_discount") - 0.05) / 100 + NUDGE / 100, 8).alias("funding"),
        )
    )
    return made.withColumns({c: F.round(F.col(c) + NUDGE, 6) for c in ("open", "high", "low", "close")})


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, expiry, code, fut, spot, dte: on each day the contracts that expire at the end of this quarter and of the next, the latter at the day's highest price."""
    end = lambda k: F.expr(f"date_sub(add_months(trunc(ts, 'quarter'), {3 * k + 3}), 1)")
    near = F.struct(end(0).alias("expiry"), F.col("close").alias("fut"))
    far = F.struct(end(1).alias("expiry"), F.col("high").alias("fut"))
    both = daily(spark, sf_dir).select("symbol", "ts", "spot", F.inline(F.array(near, far)))
    return both.withColumns({"code": F.date_format("expiry", "yyMMdd"), "dte": F.datediff("expiry", "ts")})


def dense(panel: DataFrame, values: list[str]) -> DataFrame:
    """The union grid of dates and symbols, values carried forward. The cross join is of two dimensions, never of rows."""
    grid = panel.select("ts").distinct().crossJoin(F.broadcast(panel.select("symbol").distinct()))
    past = W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return grid.join(panel, ["ts", "symbol"], "left").select("symbol", "ts", *[F.last(v, True).over(past).alias(v) for v in values])


#: The same panels for the SQL oracle.
DAILY = """daily AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS ts, round(avg(l_extendedprice / l_quantity) + 3.1e-10, 6) AS close, round(max(l_extendedprice / l_quantity) + 3.1e-10, 6) AS high,
  round(min(l_extendedprice / l_quantity) + 3.1e-10, 6) AS low, round(sum(l_extendedprice) + 3.1e-10, 4) AS qvol, round(avg(l_extendedprice / l_quantity * (1 - l_discount)) + 3.1e-10, 6) AS spot, round((avg(l_discount) - 0.05) / 100 + 3.1e-12, 8) AS funding FROM lineitem GROUP BY 1, 2)"""
WEEKLY = """weekly AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, round(avg(l_extendedprice / l_quantity) + 3.1e-10, 6) AS close, round(sum(l_extendedprice) + 3.1e-10, 4) AS qvol FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
TICKS = """ticks AS (SELECT event_type AS symbol, ts, value AS price, 1 + coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS qty, event_id % 2 = 0 AS maker, event_id AS seq FROM events)"""
BARS = """bars AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS ts,
  round(arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice)) + 3.1e-10, 6) AS open,
  round(max(l_extendedprice / l_quantity) + 3.1e-10, 6) AS high, round(min(l_extendedprice / l_quantity) + 3.1e-10, 6) AS low,
  round(arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice)) + 3.1e-10, 6) AS close,
  sum(l_quantity) AS volume, round(sum(l_extendedprice) + 3.1e-10, 4) AS qvol, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS taker,
  count(*) AS trades, round((avg(l_discount) - 0.05) / 100 + 3.1e-12, 8) AS funding FROM lineitem GROUP BY 1, 2)"""
CONTRACTS = f"""{DAILY}, both_ends AS (SELECT symbol, ts, spot, CASE k WHEN 0 THEN close ELSE high END AS fut,
  CAST(date_trunc('quarter', ts) + to_months(CAST(3 * k + 3 AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS expiry FROM daily, (SELECT unnest([0, 1]) AS k)),
contracts AS (SELECT *, strftime(expiry, '%y%m%d') AS code, date_diff('day', ts, expiry) AS dte FROM both_ends)"""
