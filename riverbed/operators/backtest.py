"""Backtest core: net returns with turnover cost, metrics, probabilistic Sharpe ratio, chronological split.

Positions are never shifted here: callers pass what was decided one row earlier (`series.lagged`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions.probability import normal_cdf


def _time(keys: list[str]):
    return W.partitionBy(*keys).orderBy("ts")


def net_return(df: DataFrame, ret: str, position: str, bps: float, keys: list[str], first_trade_free: bool = False) -> DataFrame:
    """df with turn = |change of position| and net = position * ret - turn * bps / 1e4. The first position is a trade from zero."""
    before = F.lag(position, 1, 0.0).over(_time(keys))
    turn = F.abs(F.col(position) - before)
    if first_trade_free:
        turn = F.when(F.row_number().over(_time(keys)) == 1, 0.0).otherwise(turn)
    return df.withColumn("turn", turn).withColumn("net", F.col(position) * F.col(ret) - F.col("turn") * bps / 1e4)


def split(df: DataFrame, keys: list[str], share: float = 0.6) -> DataFrame:
    """df with split: 'is' for the first floor(n * share) rows of a key in time order, 'oos' for the rest."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("split", F.when(F.row_number().over(_time(keys)) <= F.floor(n * share), "is").otherwise("oos"))


def metrics(df: DataFrame, keys: list[str], per_year: int | Column, position: str | None = None, every: bool = False) -> DataFrame:
    """One row per key: n, sharpe_ann, sr_pp, ret_ann, vol_ann, maxdd, hit, turnover, skew, kurt. Null but n below ten finite rows or without variance.

    every: infinite returns and those that are no number count as well, so that a Sharpe ratio over them is no number, as it is in SQL.
    """
    time = _time(keys)
    finite = df.where(F.col("net").isNotNull())
    if not every:
        finite = finite.where(~F.isnan("net") & (F.abs("net") < float("inf")))
    past = time.rowsBetween(W.unboundedPreceding, 0)
    # a running product: magnitudes by logarithms, the sign by the parity of negative factors, zero for good once a factor is zero
    factor = F.col("net") + 1
    size = F.exp(F.sum(F.log(F.when(factor != 0, F.abs(factor)).otherwise(1.0))).over(past))
    sign = 1 - 2 * (F.sum((factor < 0).cast("int")).over(past) % 2)
    curve = finite.withColumn("_eq", F.when(F.max((factor == 0).cast("int")).over(past) == 1, 0.0).otherwise(size * sign))
    curve = curve.withColumn("_top", F.max("_eq").over(past))
    turn = F.abs(F.col(position) - F.lag(position, 1, 0.0).over(time)) if position else F.lit(None).cast("double")
    m = curve.withColumn("_turn", turn).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("net").alias("mu"), F.stddev_samp("net").alias("sd"), F.min(F.col("_eq") / F.col("_top") - 1).alias("maxdd"),
        F.avg((F.col("net") > 0).cast("double")).alias("hit"), F.avg("_turn").alias("turnover"), F.skewness("net").alias("skew"),
        (F.kurtosis("net") + 3).alias("kurt")
    )
    ok = (F.col("n") >= 10) & (F.col("sd") > 0)
    out = {
        "sr_pp": F.col("mu") / F.col("sd"), "sharpe_ann": F.col("mu") / F.col("sd") * per_year**0.5, "ret_ann": F.col("mu") * per_year,
        "vol_ann": F.col("sd") * per_year**0.5
    }
    out |= {c: F.col(c) for c in ("maxdd", "hit", "turnover", "skew", "kurt")}
    return m.select(*keys, "n", *[F.when(ok, v).alias(k) for k, v in out.items()])


def psr(benchmark: Column | float = 0.0) -> Column:
    """Probability that the true Sharpe ratio exceeds the benchmark, from columns sr_pp, n, skew, kurt."""
    b = F.lit(benchmark) if isinstance(benchmark, float) else benchmark
    s = F.col("sr_pp")
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s))
    return F.when(F.col("n") >= 10, normal_cdf((s - b) * F.sqrt(F.col("n") - 1) / spread))


def psr_strict(benchmark: Column | float = 0.0) -> Column:
    """The same without a floor below the spread: null where that is not positive, or below three rows."""
    b = F.lit(benchmark) if isinstance(benchmark, float) else benchmark
    s = F.col("sr_pp")
    square = 1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s
    return F.when((F.col("n") > 2) & (square > 0), normal_cdf((s - b) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(square > 0, square).otherwise(1.0))))
