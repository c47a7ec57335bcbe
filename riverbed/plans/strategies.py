"""Strategy, portfolio, formula and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions import series as S
from riverbed.functions.probability import benchmark, benchmark_sql, normal_cdf_sql
from riverbed.operators import backtest as B
from riverbed.operators import formulas
from riverbed.operators.stateful import ewm, latest
from riverbed.plans.registry import query
from riverbed.plans.research import DRETS, RETS, WITH_D, _daily_returns, _weekly_returns
from riverbed.sources import panels as P

_SIG = f"{DRETS}, g AS (SELECT symbol, ts, ret, h, sign(lag(close) OVER w / lag(close, CAST(h AS INTEGER) + 1) OVER w - 1) AS pos FROM r, (SELECT unnest([7, 14, 30]) AS h) WINDOW w AS (PARTITION BY symbol, h ORDER BY ts)), n AS (SELECT symbol, h, ts, ret, coalesce(pos, 0) AS pos FROM g WHERE ret IS NOT NULL)"
_NET = f"{_SIG}, t AS (SELECT *, pos * ret - abs(pos - lag(pos, 1, 0) OVER w) * 5 / 1e4 AS net, CASE WHEN row_number() OVER w <= floor(count(*) OVER (PARTITION BY symbol, h) * 0.6) THEN 'is' ELSE 'oos' END AS split FROM n WINDOW w AS (PARTITION BY symbol, h ORDER BY ts))"
_MET = f"""{_NET}, e AS (SELECT *, CASE WHEN max(CAST(net = -1 AS INTEGER)) OVER w = 1 THEN 0 ELSE exp(sum(ln(CASE WHEN net = -1 THEN 1 ELSE abs(1 + net) END)) OVER w) * (1 - 2 * (sum(CAST(net < -1 AS INTEGER)) OVER w % 2)) END AS eq, abs(pos - lag(pos, 1, 0) OVER w) AS tn FROM t WINDOW w AS (PARTITION BY symbol, h, split ORDER BY ts)), e2 AS (SELECT *, max(eq) OVER (PARTITION BY symbol, h, split ORDER BY ts) AS top FROM e),
mu AS (SELECT *, net - avg(net) OVER (PARTITION BY symbol, h, split) AS c FROM e2),
m AS (SELECT symbol, h, split, count(*) AS n, avg(net) / stddev_samp(net) AS sr_pp, avg(net) * 365 AS ret_ann, min(eq / top - 1) AS maxdd, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS hit, avg(tn) AS turnover, avg(c * c * c) / avg(c * c) ** 1.5 AS skew, avg(c * c * c * c) / avg(c * c) ** 2 AS kurt FROM mu GROUP BY ALL HAVING count(*) >= 10 AND stddev_samp(net) > 0)"""


LOOKBACKS = (7, 14, 30)


def _momentum(spark: SparkSession, sf: str) -> DataFrame:
    """Sign of the return over h days as known one day earlier, for a grid of h: variants are rows, not loops."""
    d = _daily_returns(spark, sf)
    d = d.withColumns({f"p{h}": F.signum(F.try_divide(S.lagged("close"), S.lagged("close", h + 1)) - 1) for h in LOOKBACKS})
    grid = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"p{h}").alias("pos")) for h in LOOKBACKS])
    return d.select("symbol", "ts", "ret", F.inline(grid)).where("ret IS NOT NULL").withColumn("pos", F.coalesce("pos", F.lit(0.0)))


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["symbol", "h"]
    net = B.split(B.net_return(_momentum(spark, sf), "ret", "pos", 5, keys), keys)
    return B.metrics(net, [*keys, "split"], 365, "pos").where("sr_pp IS NOT NULL")


@query(f"""{_NET}
SELECT symbol, h, ts, net, split FROM t""", "net", "symbol h ts split")
def net_returns(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["symbol", "h"]
    return B.split(B.net_return(_momentum(spark, sf), "ret", "pos", 5, keys), keys)


@query(f"""{_MET}
SELECT *, {normal_cdf_sql("(sr_pp * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sr_pp + (kurt - 1) / 4 * sr_pp * sr_pp)))")} AS psr, sr_pp * sqrt(365) AS sharpe_ann FROM m""", "sr_pp sharpe_ann ret_ann maxdd hit turnover skew kurt psr", "symbol h split n")
def battery(spark: SparkSession, sf: str) -> DataFrame:
    """Momentum grid with costs, split in time, with metrics and the probabilistic Sharpe ratio: one job for all variants."""
    return _evaluated(spark, sf).withColumn("psr", B.psr())


@query(f"""{_MET}, o AS (SELECT * FROM m WHERE split = 'oos'), k AS (SELECT arg_max(h, (sr_pp, -h)) AS h, symbol FROM m WHERE split = 'is' GROUP BY symbol)
SELECT o.symbol, o.h, o.n, o.sr_pp FROM o JOIN k USING (symbol, h)""", "sr_pp", "symbol h n")
def select_in_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Grid search by the in-sample Sharpe ratio, reported out of sample; the first of equals wins."""
    m = _evaluated(spark, sf)
    best = m.where("split = 'is'").groupBy("symbol").agg(F.max_by("h", F.struct("sr_pp", -F.col("h"))).alias("h"))
    return m.where("split = 'oos'").join(best, ["symbol", "h"])


@query(f"""{_MET}, o AS (SELECT * FROM m WHERE split = 'oos'), s AS (SELECT {benchmark_sql("coalesce(stddev_samp(sr_pp), 0)", "count(*)")} AS star FROM o)
SELECT symbol, h, n, sr_pp, star AS sr_star_pp, {normal_cdf_sql("((sr_pp - star) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sr_pp + (kurt - 1) / 4 * sr_pp * sr_pp)))")} AS dsr_prob FROM o, s""", "sr_pp sr_star_pp dsr_prob:9", "symbol h n")
def deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    """The battery out of sample against the Sharpe ratio that its best variant would show by luck: a one-row aggregate joined back."""
    m = _evaluated(spark, sf).where("split = 'oos'")
    star = m.agg(benchmark(F.coalesce(F.stddev_samp("sr_pp"), F.lit(0.0)), F.count("*")).alias("sr_star_pp"))
    return m.join(F.broadcast(star), F.lit(True)).withColumn("dsr_prob", B.psr(F.col("sr_star_pp")))


@query(f"""{DRETS}, l AS (SELECT symbol, list(funding ORDER BY ts) AS v, list(ts ORDER BY ts) AS t FROM daily GROUP BY symbol),
u AS (SELECT symbol, t[i] AS ts, list_reduce(v[:i], lambda a, x: 0.1 * x + 0.9 * a) AS e FROM l, unnest(generate_series(1, len(v))) AS g(i)), k AS (SELECT symbol, ts, coalesce(lag(e) OVER (PARTITION BY symbol ORDER BY ts), 0) AS e FROM u)
SELECT symbol, ts, CAST(coalesce(last_value(CASE WHEN e > 1e-6 THEN 1 WHEN e < -1e-6 THEN -1 WHEN abs(e) < 1e-6 / 3 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), 0) AS INTEGER) AS state FROM k""", "", "symbol ts state")
def hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    """Enter beyond a threshold, leave inside a third of it, else hold: the state is that of the last decisive bar."""
    e = ewm(P.daily(spark, sf), ["symbol"], "funding", 19, "v").withColumn("e", S.lagged("v", 1, 0.0))
    return e.select(
        "symbol", "ts", latest(F.expr("CASE WHEN e > 1e-6 THEN 1 WHEN e < -1e-6 THEN -1 WHEN abs(e) < 1e-6 / 3 THEN 0 END")).alias("state")
    )


@query(f"""{RETS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM r)
SELECT symbol, ts, last_value(CASE WHEN i % 4 = 0 THEN ret END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS held FROM k""", "held", "symbol ts")
def rebalance_hold(spark: SparkSession, sf: str) -> DataFrame:
    return _weekly_returns(spark, sf).select("symbol", "ts", S.hold(F.col("ret"), 4).alias("held"))


@query(f"""{RETS}, k AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY ret) + (count(*) OVER (PARTITION BY ts, ret) - 1) / 2.0 AS rk FROM r WHERE ret IS NOT NULL), d AS (SELECT *, rk - avg(rk) OVER (PARTITION BY ts) AS dm FROM k),
w AS (SELECT symbol, ts, fwd, dm / nullif(sum(abs(dm)) OVER (PARTITION BY ts), 0) AS w FROM d), b AS (SELECT *, abs(coalesce(w, 0) - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS tn FROM w)
SELECT ts, sum(coalesce(w, 0) * coalesce(fwd, 0)) - 5 / 1e4 * sum(tn) AS net, sum(tn) AS turnover FROM b GROUP BY ts""", "net turnover", "ts")
def book_net(spark: SparkSession, sf: str) -> DataFrame:
    """Long-short book of demeaned ranks: weights earn the forward return and pay for their change."""
    k = _weekly_returns(spark, sf).where("ret IS NOT NULL").withColumn("rk", S.average_rank("ret")).withColumn("dm", S.neutral("rk"))
    k = k.withColumn("w", F.coalesce(F.try_divide("dm", F.sum(F.abs("dm")).over(S.by_time())), F.lit(0.0)))
    k = k.withColumn("tn", F.abs(F.col("w") - S.lagged("w", 1, 0.0)))
    return k.groupBy("ts").agg(
        (F.sum(F.col("w") * F.coalesce("fwd", F.lit(0.0))) - 5 / 1e4 * F.sum("tn")).alias("net"), F.sum("tn").alias("turnover")
    )


@query(f"""{DRETS}, x AS (SELECT symbol, ts, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) <= floor(count(*) OVER (PARTITION BY symbol) * 0.6) AS ins FROM r WHERE ret IS NOT NULL),
v AS (SELECT symbol, stddev_samp(ret) AS sd FROM x WHERE ins AND ret <> 0 GROUP BY symbol), w AS (SELECT symbol, 1 / sd / sum(1 / sd) OVER () AS w FROM v)
SELECT ts, sum(w * ret) AS book FROM x JOIN w USING (symbol) GROUP BY ts""", "book", "ts")
def inverse_vol(spark: SparkSession, sf: str) -> DataFrame:
    """Sleeves weighted by the inverse of their in-sample volatility."""
    x = B.split(_daily_returns(spark, sf).where("ret IS NOT NULL"), ["symbol"])
    v = x.where("split = 'is' AND ret <> 0").groupBy("symbol").agg((1 / F.stddev_samp("ret")).alias("i"))
    total = v.agg(F.sum("i").alias("total"))
    w = v.crossJoin(F.broadcast(total)).select("symbol", (F.col("i") / F.col("total")).alias("w"))
    return x.join(w, "symbol").groupBy("ts").agg(F.sum(F.col("w") * F.col("ret")).alias("book"))


@query(f"""{WITH_D}, ct AS (SELECT symbol, ts, close, spot, CAST(date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS expiry FROM daily), b AS (SELECT *, date_diff('day', ts, expiry) AS dte, (close / spot - 1) * 365 / greatest(date_diff('day', ts, expiry), 1) AS ann FROM ct),
e AS (SELECT * FROM b WHERE dte BETWEEN 20 AND 85 AND ann > 0.1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ann DESC, ts) = 1), c AS (SELECT *, least(ann / sum(ann) OVER (), 0.4) AS w FROM e)
SELECT symbol, ts, ann, w / sum(w) OVER () AS weight, w / sum(w) OVER () * 3 AS gross FROM c""", "ann weight gross", "symbol ts")
def select_and_size(spark: SparkSession, sf: str) -> DataFrame:
    """Best qualifying contract of each coin, sized by basis, clipped at 40 % and renormalised. The single-row totals are over symbols."""
    b = P.daily(spark, sf).withColumn(
        "expiry", F.expr("date_sub(add_months(trunc(ts, 'quarter'), 3), 1)")
    ).withColumn("dte", F.datediff("expiry", "ts"))
    b = b.withColumn("ann", (F.col("close") / F.col("spot") - 1) * 365 / F.greatest("dte", F.lit(1))).where("dte BETWEEN 20 AND 85 AND ann > 0.1")
    e = b.withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ann"), "ts"))).where("rn = 1")
    whole = lambda df, c: df.join(F.broadcast(df.agg(F.sum(c).alias("_all"))), F.lit(True))
    c = whole(e, "ann").withColumn("w", F.least(F.col("ann") / F.col("_all"), F.lit(0.4))).drop("_all")
    return whole(c, "w").withColumn("weight", F.col("w") / F.col("_all")).withColumn("gross", F.col("weight") * 3)


FORMULAS = (
    ("sub", ("rank", ("feat", "ret")), ("feat", "qvol_z")), ("div", ("tsmean3", ("feat", "ret")), ("tsstd10", ("feat", "ret"))),
    ("neut", ("tsdelta5", ("feat", "close"))), ("sign", ("delay1", ("feat", "ret")))
)


@query(f"""{RETS}, f AS (SELECT symbol, ts, close, ret, greatest(-4, least(4, (qvol - avg(qvol) OVER (PARTITION BY ts)) / (stddev_pop(qvol) OVER (PARTITION BY ts) + 1e-9))) AS qz FROM r WHERE ret IS NOT NULL),
g AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY ts) AS m, (rank() OVER (PARTITION BY ts ORDER BY ret) + (count(*) OVER (PARTITION BY ts, ret) - 1) / 2.0) AS rk, sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING) / 3 AS m3,
  sqrt(greatest(avg(ret * ret) OVER t - (avg(ret) OVER t) ** 2, 0)) AS s10, close - lag(close, 5) OVER w AS d5, lag(ret) OVER w AS r1 FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts), t AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING))
SELECT symbol, ts, CASE WHEN m > 1 THEN rk / m - 0.5 END - qz AS f0, CASE WHEN abs(CASE WHEN rn >= 10 THEN s10 END) > 1e-9 THEN CASE WHEN rn >= 3 THEN m3 END / s10 ELSE 1.0 END AS f1, d5 - avg(d5) OVER (PARTITION BY ts) AS f2, sign(r1) AS f3 FROM g""", "f0 f1 f2 f3", "symbol ts")
def formula_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Formula trees compiled to columns; all formulas share one job."""
    d = _weekly_returns(spark, sf).where("ret IS NOT NULL").withColumn("qvol_z", S.row_zscore("qvol"))
    return formulas.evaluate(d, {f"f{k}": t for k, t in enumerate(FORMULAS)})
