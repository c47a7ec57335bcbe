"""Books of many symbols: what weights earn and what their changes cost, in the ways that differ.

All take long rows (symbol, ts, w, ...). A weight that is missing is none, and `w` is what was decided before the return it earns unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions import series as S


def _weight() -> Column:
    return F.coalesce(F.col("w"), F.lit(0.0))


def _first() -> Column:
    return F.row_number().over(S.by_symbol()) == 1


def book(df: DataFrame, ret: str, bps: float, lag: int = 0, first_free: bool = False) -> DataFrame:
    """ts, net, turnover, gross: weights `lag` rows old earn ret and pay bps for their change; the first change is from nothing, or free."""
    held = df.withColumn("_w", F.lag(_weight(), lag, 0.0).over(S.by_symbol()) if lag else _weight())
    turn = F.abs(F.col("_w") - F.lag("_w", 1, 0.0).over(S.by_symbol()))
    held = held.withColumn("_turn", F.when(_first(), 0.0).otherwise(turn) if first_free else turn)
    earned = F.sum(F.col("_w") * F.coalesce(ret, F.lit(0.0)))
    return held.groupBy("ts").agg(
        (earned - bps / 1e4 * F.sum("_turn")).alias("net"), F.sum("_turn").alias("turnover"), F.sum(F.abs("_w")).alias("gross")
    )


def uneven_book(df: DataFrame, ret: str, long_bps: float, short_bps: float) -> DataFrame:
    """ts, net: a change is charged by the sign of the new weight, and a position closed to nothing is charged nothing."""
    turn = F.abs(_weight() - F.lag(_weight(), 1, 0.0).over(S.by_symbol()))
    cost = F.when(_weight() > 0, long_bps).when(_weight() < 0, short_bps).otherwise(0.0) / 1e4
    charged = df.withColumn("_cost", turn * cost)
    return charged.groupBy("ts").agg((F.sum(_weight() * F.coalesce(ret, F.lit(0.0))) - F.sum("_cost")).alias("net"))


def borrowing_book(df: DataFrame, ret: str, taker_bps: float, borrow_year: float) -> DataFrame:
    """ts, net: two legs a change at the taker's fee, and a day's borrowing on what is held."""
    turn = F.abs(_weight() - F.lag(_weight(), 1, 0.0).over(S.by_symbol()))
    charged = df.withColumn("_cost", 2 * turn * taker_bps / 1e4 + F.abs(_weight()) * borrow_year / 365)
    return charged.groupBy("ts").agg((F.sum(_weight() * F.coalesce(ret, F.lit(0.0))) - F.sum("_cost")).alias("net"))


def legs(df: DataFrame, ret: str) -> DataFrame:
    """ts, long_leg, short_leg: what either side earns before costs."""
    earned = _weight() * F.coalesce(ret, F.lit(0.0))
    return df.groupBy("ts").agg(
        F.sum(F.when(_weight() > 0, earned).otherwise(0.0)).alias("long_leg"), F.sum(F.when(_weight() < 0, earned).otherwise(0.0)).alias("short_leg")
    )


def turnover_stats(df: DataFrame, bps: float, per_year: int) -> DataFrame:
    """One row: mean turnover a bar, its cost a year, bars with a trade, mean gross and mean number of names held."""
    turn = F.abs(_weight() - F.lag(_weight(), 1, 0.0).over(S.by_symbol()))
    bar = df.withColumn("_t", turn).groupBy("ts").agg(
        F.sum("_t").alias("t"), F.sum(F.abs(_weight())).alias("g"), F.count_if(_weight() != 0).alias("k")
    )
    return bar.agg(
        F.avg("t").alias("per_bar"), (F.avg("t") * per_year * bps / 1e4).alias("cost_year"), F.count_if(F.expr("t > 1e-12")).alias("trade_bars"),
        F.avg("g").alias("gross"), F.avg("k").alias("names")
    )


def rank_weights(df: DataFrame, signal: str, least: int = 2) -> DataFrame:
    """df with w: demeaned ranks of the signal among the symbols of a time, gross one; none where fewer than `least` have a signal."""
    n = F.count(signal).over(S.by_time())
    ranked = df.withColumn("_rank", S.average_rank(signal)).withColumn("_dm", S.neutral("_rank"))
    w = F.try_divide("_dm", F.sum(F.abs("_dm")).over(S.by_time()))
    return ranked.withColumn("w", F.when(n >= least, F.coalesce(w, F.lit(0.0))).otherwise(0.0)).drop("_rank", "_dm")


def demeaned(df: DataFrame, signal: str, least: int = 4) -> DataFrame:
    """df with w: the signal less its mean among the symbols of a time, gross one; none where fewer than `least` have one."""
    n = F.count(signal).over(S.by_time())
    d = df.withColumn("_dm", S.neutral(signal))
    w = F.try_divide("_dm", F.sum(F.abs("_dm")).over(S.by_time()))
    return d.withColumn("w", F.when(n >= least, F.coalesce(w, F.lit(0.0))).otherwise(0.0)).drop("_dm")


def weekly_hold(df: DataFrame, weight: str) -> DataFrame:
    """df with w: the weight on the last row of each week that ends on Friday, held from the next row on."""
    week = F.next_day(F.date_sub("ts", 1), "FRI")
    last = F.coalesce(F.lead(week).over(S.by_symbol()) != week, F.lit(True))
    marked = df.withColumn("_w", F.when(last, F.coalesce(weight, F.lit(0.0))))
    return marked.withColumn("w", F.coalesce(F.last("_w", True).over(S.by_symbol().rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).drop("_w")


def inverse_vol(streams: DataFrame, key: str, target_year: float, per_year: int, cap: float | None = None, share: float = 0.6) -> DataFrame:
    """ts, net: streams (key, ts, net) weighed by the inverse deviation of their moving bars before the cut, then scaled to a volatility.

    The cut is `share` of all distinct times. The scale is the target over the in-sample volatility of the mix, at most cap. All figures are one row for each stream.
    """
    times = streams.select("ts").distinct().withColumn("_n", F.percent_rank().over(W.orderBy("ts")))
    cut = times.where(F.col("_n") < share).agg(F.max("ts").alias("_cut"))
    s = streams.join(F.broadcast(cut), F.lit(True))
    inv = s.where("ts <= _cut AND net <> 0").groupBy(key).agg((1 / F.stddev_samp("net")).alias("_i")).where("_i IS NOT NULL")
    mixed = s.join(F.broadcast(inv), key).join(F.broadcast(inv.agg(F.sum("_i").alias("_all"))), F.lit(True))
    mix = mixed.groupBy("ts", "_cut").agg(F.sum(F.col("net") * F.col("_i") / F.col("_all")).alias("_mix"))
    vol = mix.where("ts <= _cut").agg((F.stddev_samp("_mix") * per_year**0.5).alias("_vol"))
    scale = F.when(F.col("_vol") > 1e-4, target_year / F.col("_vol")).otherwise(1.0)
    scale = F.least(scale, F.lit(cap)) if cap else scale
    return mix.join(F.broadcast(vol), F.lit(True)).select("ts", (F.col("_mix") * scale).alias("net"))
