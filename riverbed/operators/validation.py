"""Judging results: gates fitted in sample, overlays against plain ones, robustness over variants, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.functions import series as S

EDGE, MARGINAL, DEAD = "EDGE", "MARGINAL", "DEAD"


def gates(df: DataFrame, gauges: list[str], quantile: float, above: bool = True) -> DataFrame:
    """df (symbol, ts, split, gauges) with by_<gauge>: 0 a row after the gauge lay beyond its quantile over the rows in sample, else 1. The thresholds are one row for each symbol, from one pass."""
    cuts = df.where("split = 'is'").groupBy("symbol").agg(*[F.percentile(g, F.lit(quantile)).alias(f"_cut_{g}") for g in gauges])
    j = df.join(cuts, "symbol")
    for g in gauges:
        beyond = F.col(g) > F.col(f"_cut_{g}") if above else F.col(g) < F.col(f"_cut_{g}")
        j = j.withColumn(f"by_{g}", F.when(beyond, 0.0).otherwise(1.0))
    return j.withColumns({f"by_{g}": S.lagged(f"by_{g}", 1, 1.0) for g in gauges}).drop(*[f"_cut_{g}" for g in gauges])


def robustness(m: DataFrame, keys: list[str]) -> DataFrame:
    """variants, kept (correlation of ratios in and out of sample), improving, median_change; m: metrics with split."""
    ratio = lambda s: F.max(F.when(F.col("split") == s, F.col("sr_pp"))).alias(f"_{s}")
    p = m.groupBy(*keys).agg(ratio("is"), ratio("oos")).where("_is IS NOT NULL AND _oos IS NOT NULL")
    change = F.col("_oos") - F.col("_is")
    return p.agg(
        F.count("*").alias("variants"), F.corr("_is", "_oos").alias("kept"), F.avg((change > 0).cast("double")).alias("improving"),
        F.percentile(change, F.lit(0.5)).alias("median_change")
    )


def overlay_verdict(m: DataFrame, keys: list[str], arm: str, base: str, overlay: str, trivial: str, least: float) -> DataFrame:
    """gain and shallower drawdown of the overlay over the base, whether both suffice, and whether it beats the trivial arm."""
    at = lambda a, c: F.max(F.when(F.col(arm) == a, F.col(c)))
    w = m.groupBy(*keys).agg(*[at(a, c).alias(f"_{k}{c}") for k, a in (("b", base), ("o", overlay), ("t", trivial)) for c in ("sharpe_ann", "maxdd")])
    gain, shallower = F.col("_osharpe_ann") - F.col("_bsharpe_ann"), F.col("_omaxdd") - F.col("_bmaxdd")
    return w.select(
        *keys, gain.alias("gain"), shallower.alias("shallower"), ((gain > least) & (F.col("_omaxdd") >= F.col("_bmaxdd"))).alias("improves"),
        (F.col("_osharpe_ann") > F.col("_tsharpe_ann")).alias("beats_trivial")
    )


def verdict(edge: Column, marginal: Column) -> Column:
    return F.when(edge, EDGE).when(marginal, MARGINAL).otherwise(DEAD)


def verdicts(board: DataFrame) -> DataFrame:
    """name and its verdicts; board: psr, dsr_prob, sr_star_pp, sharpe_ann, ret_ann, and sr_pp or what gives it.

    by_probability asks for both probabilities, by_benchmark for the ratio above the luckiest trial's, capped never calls an edge, survives is the strictest list.
    """
    psr, dsr, gain, sharpe = (F.col(c) for c in ("psr", "dsr_prob", "ret_ann", "sharpe_ann"))
    ratio = F.col("sr_pp") if "sr_pp" in board.columns else sharpe / F.sqrt(F.col("ppy"))
    good = (gain > 0) & (sharpe > 0)
    return board.select(
        "name",
        verdict((psr >= 0.95) & (dsr >= 0.95) & good, (psr >= 0.8) & good).alias("by_probability"),
        verdict((psr >= 0.95) & (ratio > F.col("sr_star_pp")) & (gain > 0), (psr >= 0.8) & (gain > 0)).alias("by_benchmark"),
        F.when(psr >= 0.8, MARGINAL).otherwise(DEAD).alias("capped"),
        ((gain > 0) & (sharpe > 1) & (psr >= 0.95) & (dsr >= 0.95)).alias("survives"),
    )
