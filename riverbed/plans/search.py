"""Searches over formulas and what is made of their finds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions import kernels as K
from riverbed.functions import series as S
from riverbed.functions.probability import benchmark
from riverbed.operators import backtest as B
from riverbed.operators import search as G
from riverbed.plans.backtests import evaluated
from riverbed.plans.registry import query
from riverbed.plans.research import RETS, _weekly_returns

SIZE, SEED = 150, 12345
FEATURES = ["ret_z", "mom_z", "vol_z", "qvol_z"]


def _panel(spark: SparkSession, sf: str) -> G.Panel:
    r = _weekly_returns(spark, sf).withColumns({"mom": S.simple_return("close", 5), "vol": S.rolling(F.stddev_samp, 10, "ret"), "lq": F.log("qvol")})
    z = r.select(
        "symbol", "ts", (F.col("fwd") / 10).alias("fwd"),
        *[S.row_zscore(c).alias(n) for c, n in zip(("ret", "mom", "vol", "lq"), FEATURES, strict=True)]
    )
    return G.gathered(z, FEATURES, "fwd", ragged=True)


def _cut(p: G.Panel, share: float = 0.6) -> int:
    return int(len(p.times) * share)


def _nets(spark: SparkSession, p: G.Panel, named: dict[str, np.ndarray]) -> DataFrame:
    """name, ts, pos, net: a row for each day of a handful of series."""
    rows = [(n, t, None, float(v)) for n, net in named.items() for t, v in zip(p.times, net, strict=True)]
    return spark.createDataFrame(rows, "name string, ts date, pos double, net double")


@query(None)
def alpha_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten fittest formulas of a population and three rounds of mutation, out of sample and deflated."""
    p = _panel(spark, sf)
    train = slice(0, _cut(p))
    top = G.evolved(spark, p, train, SEED, SIZE)
    m = evaluated(
        _nets(spark, p, {t: G.long_short(G.value(G.parsed(t), p) * np.sign(i), p.forward) for _, i, t in top}), ["name"], 52
    ).where("split = 'oos'")
    star = m.agg(benchmark(F.coalesce(F.stddev_samp("sr_pp"), F.lit(0.0)), F.count("*")).alias("sr_star_pp"))
    fit = spark.createDataFrame([(t, f, i) for f, i, t in top], "name string, fitness double, icir double")
    return m.join(F.broadcast(star), F.lit(True)).withColumn(
        "dsr_prob", B.psr(F.col("sr_star_pp"))
    ).join(fit, "name").orderBy(F.desc("fitness"), "name").limit(10)


def _found(spark: SparkSession, p: G.Panel, most: int = 40) -> list[tuple[float, float, str]]:
    return [x for x in G.best(spark, G.population(SEED, SIZE, FEATURES), p, slice(0, _cut(p)), most) if abs(x[1]) > 0.05]


@query(None)
def alpha_ensembles(spark: SparkSession, sf: str) -> DataFrame:
    """Four ways to make one signal of the finds: rank correlations, and metrics in and out of sample."""
    p = _panel(spark, sf)
    cut, found = _cut(p), _found(spark, p)
    if len(found) < 3:
        found = G.best(spark, G.population(SEED, SIZE, FEATURES), p, slice(0, cut), 5)
    made = G.combinations(G.aligned(found, p), np.array([x[1] for x in found]), p, slice(0, cut))
    ic = spark.createDataFrame(
        [(n, *G.information(a[:cut], p.forward[:cut]), *G.information(a[cut:], p.forward[cut:])) for n, a in made.items()],
        "name string, ic_is double, icir_is double, ic_oos double, icir_oos double"
    )
    return evaluated(_nets(spark, p, {n: G.long_short(a, p.forward) for n, a in made.items()}), ["name"], 52).join(ic, "name")


@query(None)
def alpha_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas in both halves of the first part: how far one half tells the other over all of them, how many keep their sign and size, and what these do afterwards."""
    p = _panel(spark, sf)
    cut = _cut(p)
    halves = {"a": slice(0, cut // 2), "b": slice(cut // 2, cut), "oos": slice(cut, None)}
    s = G.scored(spark, G.population(7, SIZE, FEATURES), p, halves)
    stable = F.expr("ic_a * ic_b > 0 AND abs(icir_a) > 0.08 AND abs(icir_b) > 0.08")
    return s.agg(
        F.count("*").alias("formulas"), F.corr("ic_a", "ic_b").alias("across"), F.count_if(stable).alias("stable"),
        F.avg(F.when(stable, F.signum("ic_a") * F.col("ic_oos"))).alias("stable_ic_oos"),
        F.avg(F.signum("ic_a") * F.col("ic_oos")).alias("any_ic_oos")
    )


@query(None)
def alpha_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Mean returns by fifths of the combined signal, in and out of sample, and how far the one shape tells the other."""
    p = _panel(spark, sf)
    cut, found = _cut(p), G.best(spark, G.population(SEED, SIZE, FEATURES), p, slice(0, _cut(p)), 20)
    a = G.aligned(found, p).mean(0)
    ins, oos = G.fifths(a[:cut], p.forward[:cut]), G.fifths(a[cut:], p.forward[cut:])
    rho = float(np.corrcoef(ins, oos)[0, 1]) if np.isfinite(ins).all() and np.isfinite(oos).all() else None
    num = lambda v: None if v != v else float(v)
    return spark.createDataFrame(
        [(q, num(x), num(y), rho) for q, (x, y) in enumerate(zip(ins, oos, strict=True))], "fifth int, mean_is double, mean_oos double, kept double"
    )


@query(None)
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas chosen on the first 120 weeks; every ten weeks a ridge on the 120 before predicts the next ten: metrics of the book, gross and at five basis points."""
    p = _panel(spark, sf)
    first = min(120, len(p.times) // 2)
    found = G.best(spark, G.population(SEED, SIZE, FEATURES), p, slice(0, first), 10)
    z = G.aligned(found, p)
    n, (days, names) = len(z), p.forward.shape
    x, y = z.transpose(1, 2, 0).reshape(-1, n), np.nan_to_num(p.forward).ravel()
    guess = K.walk_forward(x, y, first * names, 10 * names, 20.0).reshape(days, names)
    live = slice(first, days)
    nets = {f"{b}bp": G.long_short(guess[live], p.forward[live], float(b)) for b in (0, 5)}
    rows = [(k, t, None, float(v)) for k, net in nets.items() for t, v in zip(p.times[first:], net, strict=True)]
    m = evaluated(spark.createDataFrame(rows, "name string, ts date, pos double, net double"), ["name"], 52)
    return m.withColumn("ic", F.lit(float(G.information(guess[live], p.forward[live])[0])))


@query(None)
def monetisation(spark: SparkSession, sf: str) -> DataFrame:
    """The combined signal as a book under five schemes, with and without a day between signal and trade."""
    p = _panel(spark, sf)
    cut, found = _cut(p), G.best(spark, G.population(SEED, SIZE, FEATURES), p, slice(0, _cut(p)), 20)
    a = G.aligned(found, p).mean(0)
    r = G.ranks(a)
    n = a.shape[1]
    k = max(1, n // 10)
    vol = np.sqrt(np.nan_to_num(G._mean(np.nan_to_num(p.forward) ** 2, 20))) + 1e-9
    gross = lambda w: w / (np.abs(w).sum(1, keepdims=True) + 1e-9)
    held = np.repeat(G.weights(a)[::4], 4, 0)[: len(a)]
    schemes = {
        "rank": G.weights(a), "decile": np.where(r > n - k, 0.5 / k, 0) - np.where(r <= k, 0.5 / k, 0), "proportional": gross(G._neutral(a)),
        "inverse_vol": gross(G.weights(a) / np.vstack((np.ones((1, n)), vol[:-1]))), "monthly": held
    }
    nets = {}
    for s, w in schemes.items():
        for lag in (0, 1):
            h = np.vstack((np.zeros((lag, n)), w))[: len(w)]
            nets[f"{s}/lag{lag}"] = (h * np.nan_to_num(p.forward)).sum(1) - 5 / 1e4 * np.abs(np.diff(h, axis=0, prepend=0)).sum(1)
    return evaluated(_nets(spark, p, nets), ["name"], 52)


@query(f"""{RETS}, x AS (SELECT symbol, ts, ret, fwd / 10 AS fwd, row_number() OVER (PARTITION BY ts ORDER BY ret DESC, symbol DESC) AS dn, count(*) OVER (PARTITION BY ts) AS n, rank() OVER (PARTITION BY ts ORDER BY ret) + (count(*) OVER (PARTITION BY ts, ret) - 1) / 2.0 AS rk FROM r WHERE ret IS NOT NULL AND fwd IS NOT NULL),
d AS (SELECT *, rk - avg(rk) OVER (PARTITION BY ts) AS d FROM x), w AS (SELECT *, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY ts), 0), 0) AS w FROM d), t AS (SELECT *, abs(w - lag(w, 1, 0) OVER (PARTITION BY symbol ORDER BY ts)) AS tn FROM w)
SELECT bps, ts, sum(w * fwd) - sum(tn) * bps / 1e4 AS long_short, avg(CASE WHEN dn <= greatest(1, n // 5) THEN fwd END) - avg(fwd) AS long_only FROM t, (SELECT unnest([0, 1, 5]) AS bps) GROUP BY bps, ts""", "long_short long_only", "bps ts")
def signal_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    """One signal gross and at one and five basis points, and its top fifth against the mean."""
    from pyspark.sql import Window as W

    t = W.partitionBy("ts")
    x = _weekly_returns(spark, sf).where("ret IS NOT NULL AND fwd IS NOT NULL").withColumn("fwd", F.col("fwd") / 10).withColumns(
        {"dn": F.row_number().over(t.orderBy(F.desc("ret"), F.desc("symbol"))), "n": F.count("*").over(t), "rk": S.average_rank("ret")}
    )
    w = x.withColumn("d", S.neutral("rk")).withColumn(
        "w", F.coalesce(F.try_divide("d", F.sum(F.abs("d")).over(t)), F.lit(0.0))
    ).withColumn("tn", F.abs(F.col("w") - S.lagged("w", 1, 0.0)))
    g = w.groupBy("ts").agg(
        F.sum(F.col("w") * F.col("fwd")).alias("gross"), F.sum("tn").alias("turn"),
        (F.avg(F.expr("CASE WHEN dn <= greatest(1, n DIV 5) THEN fwd END")) - F.avg("fwd")).alias("long_only")
    )
    return g.withColumn("bps", F.explode(F.array(*map(F.lit, (0, 1, 5))))).withColumn("long_short", F.expr("gross - turn * bps / 1e4D"))
