"""Panel, window, cross-section and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions import series as S
from riverbed.operators.joins import asof
from riverbed.operators.stateful import ewm
from riverbed.plans.registry import query
from riverbed.sources import panels as P

WITH_D, WITH_W, WITH_T = f"WITH {P.DAILY}", f"WITH {P.WEEKLY}", f"WITH {P.TICKS}"
#: Simple returns of the weekly universe, as both sides start from them.
RETS = f"{WITH_W}, r AS (SELECT symbol, ts, close, qvol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd FROM weekly)"
DRETS = f"{WITH_D}, r AS (SELECT symbol, ts, close, spot, funding, qvol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM daily)"


def _weekly_returns(spark: SparkSession, sf: str) -> DataFrame:
    return P.weekly_universe(spark, sf).withColumns({"ret": S.simple_return("close"), "fwd": S.forward_return("close")})


def _daily_returns(spark: SparkSession, sf: str) -> DataFrame:
    return P.daily(spark, sf).withColumn("ret", S.simple_return("close"))


@query(f"""{WITH_T}
SELECT symbol, time_bucket(INTERVAL '8 hours', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(qty) AS volume, count(*) AS trades FROM ticks GROUP BY 1, 2""", "open high low close volume", "symbol ts trades")
def klines_8h(spark: SparkSession, sf: str) -> DataFrame:
    order = F.struct("ts", "seq")
    bars = P.ticks(spark, sf).groupBy("symbol", F.window("ts", "8 hours").start.alias("bar"))
    return bars.agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"), F.count("*").alias("trades")
    ).withColumnRenamed("bar", "ts")


@query(f"""{WITH_T}
SELECT symbol, date_trunc('minute', ts) AS ts, arg_max(price, (ts, seq)) AS close, sum(qty) AS vol, sum(CASE WHEN maker THEN -qty ELSE qty END) AS ofi, count(*) AS ntr, CASE WHEN sum(qty) <> 0 THEN sum(CASE WHEN maker THEN -qty ELSE qty END) / sum(qty) END AS ofi_norm FROM ticks GROUP BY 1, 2""", "close vol ofi ofi_norm", "symbol ts ntr")
def ofi_bars(spark: SparkSession, sf: str) -> DataFrame:
    signed = F.when(F.col("maker"), -F.col("qty")).otherwise(F.col("qty"))
    bars = P.ticks(spark, sf).groupBy("symbol", F.window("ts", "1 minute").start.alias("bar")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("qty").alias("vol"), F.sum(signed).alias("ofi"), F.count("*").alias("ntr")
    )
    return bars.withColumn("ofi_norm", F.try_divide("ofi", "vol")).withColumnRenamed("bar", "ts")


@query(f"""{WITH_T}
SELECT symbol, time_bucket(INTERVAL '5 seconds', ts) AS ts, arg_max(price, (ts, seq)) AS mid, sum(CASE WHEN maker THEN qty ELSE 0 END) AS sell_agg, sum(CASE WHEN maker THEN 0 ELSE qty END) AS buy_agg FROM ticks GROUP BY 1, 2""", "mid sell_agg buy_agg", "symbol ts")
def mm_bars(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda m: F.sum(F.when(F.col("maker") == m, F.col("qty")).otherwise(0.0))
    return P.ticks(spark, sf).groupBy("symbol", F.window("ts", "5 seconds").start.alias("bar")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("mid"), side(True).alias("sell_agg"), side(False).alias("buy_agg")
    ).withColumnRenamed("bar", "ts")


@query(f"""{WITH_D}
SELECT * FROM daily""", "close high low qvol spot funding:9", "symbol ts")
def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    return P.daily(spark, sf)


@query(f"""{WITH_D}, grid AS (SELECT symbol, ts FROM (SELECT DISTINCT ts FROM daily), (SELECT DISTINCT symbol FROM daily))
SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS close FROM grid LEFT JOIN daily USING (symbol, ts)""", "close", "symbol ts")
def densify_ffill(spark: SparkSession, sf: str) -> DataFrame:
    return P.dense(P.daily(spark, sf).select("symbol", "ts", "close"), ["close"])


@query(f"""{WITH_D}, n AS (SELECT count(DISTINCT symbol) AS n FROM daily)
SELECT symbol, ts, close FROM daily WHERE ts IN (SELECT ts FROM daily GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT n FROM n))""", "close", "symbol ts")
def intersect_panel(spark: SparkSession, sf: str) -> DataFrame:
    d = P.daily(spark, sf).select("symbol", "ts", "close")
    n = d.agg(F.count_distinct("symbol").alias("n"))
    whole = d.groupBy("ts").agg(F.count_distinct("symbol").alias("c")).join(F.broadcast(n), F.col("c") == F.col("n"), "left_semi")
    return d.join(whole, "ts", "left_semi")


@query(f"""{WITH_D}, w AS (SELECT *, lag(close) OVER x AS p, lag(close, 5) OVER x AS p5, lead(close) OVER x AS nx FROM daily WINDOW x AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, close / p - 1 AS ret, close / p5 - 1 AS ret5, ln(close) - ln(p) AS logret, nx / close - 1 AS fwd, close - p AS diff, funding + spot / lag(spot) OVER (PARTITION BY symbol ORDER BY ts) - close / p AS carry FROM w""", "ret ret5 logret fwd diff carry", "symbol ts")
def returns(spark: SparkSession, sf: str) -> DataFrame:
    d = P.daily(spark, sf)
    return d.select(
        "symbol", "ts", S.simple_return("close").alias("ret"), S.simple_return("close", 5).alias("ret5"), S.log_return("close").alias("logret"),
        S.forward_return("close").alias("fwd"), (F.col("close") - S.lagged("close")).alias("diff"),
        (F.col("funding") + S.simple_return("spot") - S.simple_return("close")).alias("carry")
    )


@query(f"""{DRETS}, w AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(ret) OVER t AS c, sum(coalesce(ret, 0)) OVER t / 10 AS m0, avg(ret) OVER t AS m, stddev_samp(ret) OVER t AS sd, avg(close) OVER t AS a, avg(close * close) OVER t AS a2, sum(ret) OVER t AS s, ret FROM r WINDOW t AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING))
SELECT symbol, ts, CASE WHEN rn >= 10 THEN m0 END AS mean0, CASE WHEN c >= 10 THEN m END AS mean, CASE WHEN c >= 10 THEN sd END AS sd, CASE WHEN rn >= 10 THEN sqrt(greatest(a2 - a * a, 0)) END AS sd_pop, CASE WHEN c >= 10 THEN s END AS total, CASE WHEN c >= 5 AND sd > 0 THEN (ret - m) / sd END AS z FROM w""", "mean0 mean sd sd_pop total z", "symbol ts")
def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = _daily_returns(spark, sf)
    return d.select(
        "symbol", "ts", S.rolling_mean("ret", 10).alias("mean0"), S.rolling(F.avg, 10, "ret").alias("mean"),
        S.rolling(F.stddev_samp, 10, "ret").alias("sd"), S.rolling_std_pop("close", 10).alias("sd_pop"), S.rolling(F.sum, 10, "ret").alias("total"),
        S.zscore("ret", 10, 5).alias("z")
    )


@query(f"""{DRETS}
SELECT symbol, ts, CASE WHEN count(ret) OVER t >= 24 THEN quantile_cont(ret, 0.2) OVER t END AS q20, CASE WHEN count(ret) OVER t >= 24 THEN quantile_cont(ret, 0.5) OVER t END AS median FROM r WINDOW t AS (PARTITION BY symbol ORDER BY ts ROWS 71 PRECEDING)""", "q20 median", "symbol ts")
def rolling_quantile(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda p: S.rolling(lambda c: F.percentile(c, F.lit(p)), 72, "ret", least=24)
    return _daily_returns(spark, sf).select("symbol", "ts", q(0.2).alias("q20"), q(0.5).alias("median"))


@query(f"""{RETS}, m AS (SELECT ts, avg(ret) AS mkt FROM r GROUP BY ts), j AS (SELECT symbol, r.ts, ret, mkt FROM r JOIN m USING (ts)),
b AS (SELECT symbol, ts, CASE WHEN count(ret) OVER t >= 20 AND var_samp(mkt) OVER t > 0 THEN covar_samp(ret, mkt) OVER t / var_samp(mkt) OVER t END AS b FROM j WINDOW t AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
SELECT symbol, ts, lag(b) OVER (PARTITION BY symbol ORDER BY ts) AS beta FROM b""", "beta", "symbol ts")
def trailing_beta(spark: SparkSession, sf: str) -> DataFrame:
    r = _weekly_returns(spark, sf).select("symbol", "ts", "ret")
    j = r.join(r.groupBy("ts").agg(F.avg("ret").alias("mkt")), "ts")
    b = F.when(
        F.count("ret").over(S.trailing(20)) >= 20,
        F.try_divide(F.covar_samp("ret", "mkt").over(S.trailing(20)), F.var_samp("mkt").over(S.trailing(20)))
    )
    return j.withColumn("b", b).select("symbol", "ts", S.lagged("b").alias("beta"))


@query(f"""{WITH_D}, l AS (SELECT symbol, list(funding ORDER BY ts) AS v, list(ts ORDER BY ts) AS t FROM daily GROUP BY symbol),
u AS (SELECT symbol, t[i] AS ts, list_reduce(v[:i], lambda a, x: 0.1 * x + 0.9 * a) AS e FROM l, unnest(generate_series(1, len(v))) AS g(i))
SELECT symbol, ts, e AS ema, coalesce(lag(e) OVER (PARTITION BY symbol ORDER BY ts), 0) AS ema_lag FROM u""", "ema:12 ema_lag:12", "symbol ts")
def ewm_funding(spark: SparkSession, sf: str) -> DataFrame:
    return ewm(P.daily(spark, sf), ["symbol"], "funding", 19).withColumn("ema_lag", S.lagged("ema", 1, 0.0))


@query(f"""{RETS}, k AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY ret) + (count(*) OVER (PARTITION BY ts, ret) - 1) / 2.0 AS rk, avg(ret) OVER t AS m, stddev_pop(ret) OVER t AS sd FROM r WHERE ret IS NOT NULL WINDOW t AS (PARTITION BY ts)),
d AS (SELECT *, rk - avg(rk) OVER (PARTITION BY ts) AS dm FROM k)
SELECT symbol, ts, rk AS rank, greatest(-4, least(4, (ret - m) / (sd + 1e-9))) AS z, ret - m AS neut, CASE WHEN sum(abs(dm)) OVER (PARTITION BY ts) > 0 THEN dm / sum(abs(dm)) OVER (PARTITION BY ts) END AS weight FROM d""", "rank z neut weight", "symbol ts")
def cross_section(spark: SparkSession, sf: str) -> DataFrame:
    r = _weekly_returns(spark, sf).where("ret IS NOT NULL").withColumns(
        {"rank": S.average_rank("ret"), "z": S.row_zscore("ret"), "neut": S.neutral("ret")}
    )
    r = r.withColumn("dm", S.neutral("rank"))
    return r.withColumn("weight", F.try_divide("dm", F.sum(F.abs("dm")).over(S.by_time())))


@query(f"""{RETS}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY ret, symbol) AS up, row_number() OVER (PARTITION BY ts ORDER BY ret DESC, symbol DESC) AS dn, count(*) OVER (PARTITION BY ts) AS n FROM r WHERE ret IS NOT NULL)
SELECT symbol, ts, CASE WHEN n < 6 THEN 0 WHEN dn <= greatest(1, n // 3) THEN 1.0 / greatest(1, n // 3) WHEN up <= greatest(1, n // 3) THEN -1.0 / greatest(1, n // 3) ELSE 0 END AS third,
CASE WHEN n < 10 THEN 0 WHEN dn <= greatest(1, n // 10) THEN 0.5 / greatest(1, n // 10) WHEN up <= greatest(1, n // 10) THEN -0.5 / greatest(1, n // 10) ELSE 0 END AS decile, CASE WHEN n >= 10 THEN CAST(ceil(up * 5.0 / n) - 1 AS INTEGER) END AS quintile FROM k""", "third decile", "symbol ts quintile")
def bucket_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Thirds, deciles and quintiles of last week's return; ties by symbol."""
    r = _weekly_returns(spark, sf).where("ret IS NOT NULL")
    up, dn, n = F.row_number().over(W.partitionBy("ts").orderBy("ret", "symbol")), F.row_number().over(
        W.partitionBy("ts").orderBy(F.desc("ret"), F.desc("symbol"))
    ), F.count("*").over(S.by_time())
    r = r.withColumns({"up": up, "dn": dn, "n": n})

    def ends(k: str, each: float, least: int):
        return F.expr(f"CASE WHEN n < {least} THEN 0.0D WHEN dn <= {k} THEN {each}D / {k} WHEN up <= {k} THEN -{each}D / {k} ELSE 0.0D END")

    return r.select(
        "symbol", "ts", ends("greatest(1, n DIV 3)", 1.0, 6).alias("third"), ends("greatest(1, n DIV 10)", 0.5, 10).alias("decile"),
        F.expr("CASE WHEN n >= 10 THEN CAST(ceil(up * 5.0D / n) - 1 AS int) END").alias("quintile")
    )


@query(f"""{RETS}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY ret, symbol) AS up, count(*) OVER (PARTITION BY ts) AS n FROM r WHERE ret IS NOT NULL AND fwd IS NOT NULL),
q AS (SELECT ts, CAST(ceil(up * 5.0 / n) - 1 AS INTEGER) AS quintile, avg(fwd) AS m FROM k WHERE n >= 10 GROUP BY 1, 2)
SELECT quintile, avg(m) AS mean_fwd, count(*) AS days FROM q GROUP BY quintile""", "mean_fwd", "quintile days")
def quintile_profile(spark: SparkSession, sf: str) -> DataFrame:
    r = _weekly_returns(spark, sf).where("ret IS NOT NULL AND fwd IS NOT NULL").withColumns(
        {"up": F.row_number().over(W.partitionBy("ts").orderBy("ret", "symbol")), "n": F.count("*").over(S.by_time())}
    )
    q = r.where("n >= 10").groupBy("ts", F.expr("CAST(ceil(up * 5.0D / n) - 1 AS int)").alias("quintile")).agg(F.avg("fwd").alias("m"))
    return q.groupBy("quintile").agg(F.avg("m").alias("mean_fwd"), F.count("*").alias("days"))


@query(f"""{RETS}, x AS (SELECT * FROM r WHERE ret IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY ret) + (count(*) OVER (PARTITION BY ts, ret) - 1) / 2.0 AS a, rank() OVER (PARTITION BY ts ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, fwd) - 1) / 2.0 AS b FROM x),
i AS (SELECT ts, corr(a, b) AS ic FROM k GROUP BY ts HAVING count(*) > 4 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0)
SELECT CASE WHEN count(*) > 20 THEN avg(ic) ELSE 0 END AS ic, CASE WHEN count(*) > 20 THEN avg(ic) / (stddev_pop(ic) + 1e-9) ELSE 0 END AS icir, count(*) AS days FROM i""", "ic icir", "days")
def rank_ic(spark: SparkSession, sf: str) -> DataFrame:
    r = _weekly_returns(spark, sf).where("ret IS NOT NULL AND fwd IS NOT NULL").select(
        "ts", S.average_rank("ret").alias("a"), S.average_rank("fwd").alias("b")
    )
    ic = r.groupBy("ts").agg(
        F.count("*").alias("n"), F.corr("a", "b").alias("ic"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb")
    ).where("n > 4 AND sa > 0 AND sb > 0")
    enough = F.count("*") > 20
    return ic.agg(
        F.when(enough, F.avg("ic")).otherwise(0.0).alias("ic"),
        F.when(enough, F.avg("ic") / (F.stddev_pop("ic") + 1e-9)).otherwise(0.0).alias("icir"), F.count("*").alias("days")
    )


@query(f"""{WITH_D}
SELECT symbol, CAST(ts + CAST((12 - dayofweek(ts)) % 7 AS INTEGER) AS DATE) AS week, CASE WHEN count(funding) >= 5 THEN sum(funding) * 1e4 END AS funding_bp, arg_max(close, ts) AS close FROM daily GROUP BY 1, 2""", "funding_bp close", "symbol week")
def weekly_friday(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks that end on Friday; a sum needs five values."""
    return P.daily(spark, sf).groupBy("symbol", F.next_day(F.date_sub("ts", 1), "FRI").alias("week")).agg(
        F.when(F.count("funding") >= 5, F.sum("funding") * 1e4).alias("funding_bp"), F.max_by("close", "ts").alias("close")
    )


@query(f"""{RETS}, p AS (SELECT a.symbol AS a, b.symbol AS b, a.ret AS x, b.ret AS y FROM r a JOIN r b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL)
SELECT a, b, count(*) AS n, corr(x, y) AS rho, covar_samp(x, y) / nullif(var_pop(y), 0) AS beta, regr_slope(x, y) AS slope, regr_intercept(x, y) AS intercept FROM p GROUP BY a, b""", "rho beta slope intercept", "a b n")
def pair_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Unordered pairs of symbols, joined on time: rows grow with the universe, never with time alone."""
    r = _weekly_returns(spark, sf).where("ret IS NOT NULL")
    p = r.select("ts", F.col("symbol").alias("a"), F.col("ret").alias("x")).join(
        r.select("ts", F.col("symbol").alias("b"), F.col("ret").alias("y")), "ts"
    ).where("a < b")
    return p.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.corr("x", "y").alias("rho"), F.try_divide(F.covar_samp("x", "y"), F.var_pop("y")).alias("beta"),
        F.regr_slope("x", "y").alias("slope"), F.regr_intercept("x", "y").alias("intercept")
    )


@query(f"""{DRETS}, x AS (SELECT symbol, ts, ret, ret - avg(ret) OVER (PARTITION BY symbol) AS e, lag(close) OVER w AS lc, close - lag(close) OVER w AS dc, lag(ret) OVER w AS lr FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
y AS (SELECT symbol, regr_slope(dc, lc) AS b, regr_count(dc, lc) AS n, regr_sxx(dc, lc) AS sxx, regr_syy(dc, lc) AS syy, regr_sxy(dc, lc) AS sxy, corr(ret, lr) AS acf1 FROM x GROUP BY symbol)
SELECT symbol, n, acf1, CASE WHEN b < 0 THEN ln(2) / -b END AS half_life, b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS df_t, greatest(0, least(0.999, acf1)) AS branching FROM y""", "acf1 half_life df_t branching", "symbol n")
def mean_reversion(spark: SparkSession, sf: str) -> DataFrame:
    """First autocorrelation, half-life and Dickey-Fuller t from regression sums."""
    x = _daily_returns(spark, sf).withColumns({"lc": S.lagged("close"), "lr": S.lagged("ret")}).withColumn("dc", F.col("close") - F.col("lc"))
    y = x.groupBy("symbol").agg(
        F.regr_slope("dc", "lc").alias("b"), F.regr_count("dc", "lc").alias("n"), F.regr_sxx("dc", "lc").alias("sxx"),
        F.regr_syy("dc", "lc").alias("syy"), F.regr_sxy("dc", "lc").alias("sxy"), F.corr("ret", "lr").alias("acf1")
    )
    return y.select(
        "symbol", "n", "acf1", F.expr("CASE WHEN b < 0 THEN ln(2) / -b END").alias("half_life"),
        F.expr("b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)").alias("df_t"), F.expr("greatest(0.0D, least(0.999D, acf1))").alias("branching")
    )


@query(f"""{DRETS}, x AS (SELECT symbol, ts, ret, ret - avg(ret) OVER (PARTITION BY symbol) AS e FROM r WHERE ret IS NOT NULL), l AS (SELECT symbol, k, e * lag(e, CAST(k AS INTEGER)) OVER (PARTITION BY symbol, k ORDER BY ts) AS p, e FROM x, unnest(generate_series(1, 10)) AS g(k)),
a AS (SELECT symbol, k, sum(p) / sum(e * e) AS rho, count(e) AS n FROM l GROUP BY symbol, k), q AS (SELECT symbol, max(n) AS n, max(n) * (max(n) + 2) * sum(rho * rho / (n - k)) AS q FROM a GROUP BY symbol)
SELECT symbol, n, q, exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24) AS p FROM q""", "q p", "symbol n")
def ljung_box(spark: SparkSession, sf: str) -> DataFrame:
    """Ten lags; the p-value is closed for an even number of degrees of freedom."""
    x = _daily_returns(spark, sf).where("ret IS NOT NULL").withColumn("e", F.col("ret") - F.avg("ret").over(W.partitionBy("symbol")))
    lags = [(F.col("e") * F.lag("e", k).over(S.by_symbol())).alias(f"p{k}") for k in range(1, 11)]
    a = x.select("symbol", "e", *lags).groupBy("symbol").agg(
        F.count("e").alias("n"), *[(F.sum(f"p{k}") / F.sum(F.col("e") * F.col("e"))).alias(f"r{k}") for k in range(1, 11)]
    )
    h = "q / 2"
    q = a.selectExpr("symbol", "n", "n * (n + 2) * (" + " + ".join(f"r{k} * r{k} / (n - {k})" for k in range(1, 11)) + ") AS q")
    return q.selectExpr("symbol", "n", "q", f"exp(-{h}) * (1 + {h} + pow({h}, 2) / 2 + pow({h}, 3) / 6 + pow({h}, 4) / 24) AS p")


@query(f"""{DRETS}, x AS (SELECT symbol, ts, ret, row_number() OVER w AS rn, avg(ret) OVER (PARTITION BY symbol) AS mu, count(*) OVER (PARTITION BY symbol) AS n, sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 3 PRECEDING) AS s4 FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, any_value(n) AS n, (sum(CASE WHEN rn >= 4 THEN (s4 - 4 * mu) ** 2 END) / (4 * (any_value(n) - 3) * (1 - 4.0 / any_value(n)))) / (sum((ret - mu) ** 2) / (any_value(n) - 1)) AS vr4 FROM x GROUP BY symbol""", "vr4", "symbol n")
def variance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    every = W.partitionBy("symbol")
    x = _daily_returns(spark, sf).where("ret IS NOT NULL").withColumns(
        {
            "rn": F.row_number().over(S.by_symbol()), "mu": F.avg("ret").over(every), "n": F.count("*").over(every),
            "s4": F.sum("ret").over(S.trailing(4))
        }
    )
    return x.groupBy("symbol").agg(
        F.first("n").alias("n"),
        F.expr(
            "(sum(CASE WHEN rn >= 4 THEN pow(s4 - 4 * mu, 2) END) / (4 * (first(n) - 3) * (1 - 4.0D / first(n)))) / (sum(pow(ret - mu, 2)) / (first(n) - 1))"
        ).alias("vr4")
    )


@query(f"""{WITH_D}, o AS (SELECT CAST(o_orderdate AS DATE) AS ts, count(*) AS oi FROM orders GROUP BY 1)
SELECT symbol, d.ts, oi FROM daily d ASOF LEFT JOIN o ON d.ts >= o.ts""", "", "symbol ts oi")
def asof_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The last known order count at each bar."""
    bars = P.daily(spark, sf).select("ts", "symbol")
    counts = P.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.count("*").alias("oi"))
    # every symbol gets its own copy of the counts: small days by few symbols, and no window over all rows
    each = counts.join(F.broadcast(bars.select("symbol").distinct()), F.lit(True))
    return asof(bars, each, ["symbol"], ["oi"])


@query(f"""{WITH_D}, c AS (SELECT *, last_value(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM daily), t AS (SELECT *, min(CAST(close = fin AS INTEGER)) OVER (PARTITION BY symbol ORDER BY ts DESC) AS tail FROM c)
SELECT symbol, count(*) AS n, CAST(sum(tail) AS BIGINT) AS run, CAST(count(*) - CASE WHEN sum(tail) > 1 THEN sum(tail) - 1 ELSE 0 END AS BIGINT) AS kept FROM t GROUP BY symbol""", "", "symbol n run kept")
def frozen_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left after a trailing run of the last price is cut to its first bar."""
    d = P.daily(spark, sf).withColumn("fin", F.last("close").over(S.by_symbol().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    d = d.withColumn(
        "tail",
        F.min((F.col("close") == F.col("fin")).cast("int")).over(W.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(W.unboundedPreceding, 0))
    )
    return d.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("tail").alias("run")).withColumn(
        "kept", F.expr("n - CASE WHEN run > 1 THEN run - 1 ELSE 0 END")
    )


_CONTRACTS = "ct AS (SELECT symbol, ts, close, spot, CAST(date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS expiry FROM daily), b AS (SELECT *, date_diff('day', ts, expiry) AS dte FROM ct)"


@query(f"""{WITH_D}, {_CONTRACTS}
SELECT symbol, strftime(expiry, '%y%m%d') AS code, count(*) AS bars, avg((close / spot - 1) * 365 / greatest(dte, 1)) AS ann_basis, arg_min((close / spot - 1) * 365 / greatest(dte, 1), ts) AS entry_basis FROM b WHERE dte BETWEEN 5 AND 85 GROUP BY 1, 2""", "ann_basis entry_basis", "symbol code bars")
def contract_basis(spark: SparkSession, sf: str) -> DataFrame:
    """Annualised basis of dated contracts between 85 and 5 days to expiry."""
    b = P.daily(spark, sf).withColumn(
        "expiry", F.expr("date_sub(add_months(trunc(ts, 'quarter'), 3), 1)")
    ).withColumn("dte", F.datediff("expiry", "ts"))
    ann = (F.col("close") / F.col("spot") - 1) * 365 / F.greatest("dte", F.lit(1))
    return b.where("dte BETWEEN 5 AND 85").groupBy("symbol", F.date_format("expiry", "yyMMdd").alias("code")).agg(
        F.count("*").alias("bars"), F.avg(ann).alias("ann_basis"), F.min_by(ann, "ts").alias("entry_basis")
    )


@query(f"""{WITH_W}, v AS (SELECT symbol, sum(qvol) AS vol FROM weekly GROUP BY symbol)
SELECT symbol, vol FROM v WHERE vol >= 1000 AND symbol LIKE 'Brand#%' ORDER BY vol DESC, symbol LIMIT 10""", "vol", "symbol")
def liquidity_universe(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most traded symbols: the limit is the feature."""
    return P.weekly_universe(spark, sf).groupBy("symbol").agg(F.sum("qvol").alias("vol")).where(
        "vol >= 1000 AND symbol LIKE 'Brand#%'"
    ).orderBy(F.desc("vol"), "symbol").limit(10)


def _levels(n: int) -> str:
    """The chain of causal smoothings in SQL."""
    out, prev = [], "s0"
    for j in range(n):
        out.append(
            f"l{j + 1} AS (SELECT *, 0.5 * {prev} + 0.5 * coalesce(lag({prev}, {2**j}) OVER (PARTITION BY symbol ORDER BY ts), first_value({prev}) OVER (PARTITION BY symbol ORDER BY ts)) AS s{j + 1} FROM {'l' + str(j) if j else 'l0'})"
        )
        prev = f"s{j + 1}"
    return ", ".join(out)


@query(f"""{WITH_D}, l0 AS (SELECT symbol, ts, close AS s0 FROM daily), {_levels(4)}
SELECT symbol, ts, s0 - s1 AS d1, s1 - s2 AS d2, s2 - s3 AS d3, s3 - s4 AS d4, s4 AS smooth FROM l4""", "d1 d2 d3 d4 smooth", "symbol ts")
def wavelet(spark: SparkSession, sf: str) -> DataFrame:
    """Causal a-trous decomposition: smoothing j averages with the row 2^j earlier."""
    d = P.daily(spark, sf).select("symbol", "ts", F.col("close").alias("s0"))
    for j in range(4):
        d = d.withColumn(f"s{j + 1}", 0.5 * F.col(f"s{j}") + 0.5 * F.coalesce(S.lagged(f"s{j}", 2**j), F.first(f"s{j}").over(S.by_symbol())))
    return d.select("symbol", "ts", *[(F.col(f"s{j}") - F.col(f"s{j + 1}")).alias(f"d{j + 1}") for j in range(4)], F.col("s4").alias("smooth"))


def fracdiff_weights(d: float, tau: float) -> list[float]:
    """Weights of fractional differencing until they fall below tau."""
    w = [1.0]
    while abs(x := -w[-1] * (d - len(w) + 1) / len(w)) >= tau:
        w.append(x)
    return w


_FD = fracdiff_weights(0.4, 0.01)


@query(f"""{WITH_D}
SELECT symbol, ts, {" + ".join(f"{w!r} * lag(ln(close), {k}) OVER w" for k, w in enumerate(_FD))} AS fd FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts)""", "fd", "symbol ts")
def fracdiff(spark: SparkSession, sf: str) -> DataFrame:
    total = sum((w * F.lag(F.log("close"), k).over(S.by_symbol()) for k, w in enumerate(_FD)), F.lit(0.0))
    return P.daily(spark, sf).select("symbol", "ts", total.alias("fd"))


@query(f"""{DRETS}, x AS (SELECT symbol, ts, ret AS c, lag(ret) OVER w AS b, lag(ret, 2) OVER w AS a FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
p AS (SELECT symbol, concat(CAST(a <= b AS INTEGER), CAST(a <= c AS INTEGER), CAST(b <= c AS INTEGER)) AS pat, count(*) AS n FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2)
SELECT symbol, -sum(f * ln(f)) / ln(6) AS entropy FROM (SELECT symbol, n / sum(n) OVER (PARTITION BY symbol) AS f FROM p) GROUP BY symbol""", "entropy", "symbol")
def permutation_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Order patterns of three successive returns; ties keep their order."""
    x = _daily_returns(spark, sf).select("symbol", F.col("ret").alias("c"), S.lagged("ret").alias("b"), S.lagged("ret", 2).alias("a")).dropna()
    p = x.groupBy("symbol", F.expr("concat(int(a <= b), int(a <= c), int(b <= c))").alias("pat")).agg(F.count("*").alias("n"))
    f = p.withColumn("f", F.col("n") / F.sum("n").over(W.partitionBy("symbol")))
    return f.groupBy("symbol").agg((-F.sum(F.col("f") * F.log("f")) / F.log(F.lit(6.0))).alias("entropy"))


@query(f"""{DRETS}, l AS (SELECT symbol, ts, list(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a, list(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING) AS b FROM r WHERE ret IS NOT NULL)
SELECT symbol, ts, list_sum([abs(x[1] - x[2]) FOR x IN list_zip(list_sort(a), list_sort(b))]) / 20 AS w1 FROM l WHERE len(b) = 20""", "w1", "symbol ts")
def wasserstein(spark: SparkSession, sf: str) -> DataFrame:
    """Distance between the last 20 returns and the 20 before."""
    r = _daily_returns(spark, sf).where("ret IS NOT NULL")
    r = r.select(
        "symbol", "ts", F.collect_list("ret").over(S.by_symbol().rowsBetween(-19, 0)).alias("a"),
        F.collect_list("ret").over(S.by_symbol().rowsBetween(-39, -20)).alias("b")
    ).where("size(b) = 20")
    return r.select(
        "symbol", "ts", F.expr("aggregate(zip_with(array_sort(a), array_sort(b), (x, y) -> abs(x - y)), 0.0D, (s, x) -> s + x) / 20").alias("w1")
    )


@query(f"""{DRETS}, l AS (SELECT symbol, -ret AS loss, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS rn FROM r WHERE ret < 0)
SELECT symbol, 1 / (avg(ln(loss)) FILTER (rn <= 20) - max(CASE WHEN rn = 21 THEN ln(loss) END)) AS alpha FROM l GROUP BY symbol HAVING count(*) > 20""", "alpha", "symbol")
def hill_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Hill index of the 20 largest losses."""
    x = _daily_returns(spark, sf).where("ret < 0").select(
        "symbol", F.log(-F.col("ret")).alias("l"), F.row_number().over(W.partitionBy("symbol").orderBy("ret")).alias("rn")
    ).where("rn <= 21")
    return x.groupBy("symbol").agg(
        (1 / (F.avg(F.when(F.col("rn") <= 20, F.col("l"))) - F.max(F.when(F.col("rn") == 21, F.col("l"))))).alias("alpha"), F.count("*").alias("n")
    ).where("n > 20")


@query(f"""{RETS}, m AS (SELECT ts, avg(ret) AS mkt FROM r GROUP BY ts), s AS (SELECT symbol, ts, CAST(ret > 0 AS INTEGER) AS y, lag(CAST(ret > 0 AS INTEGER)) OVER w AS y1, lag(CAST(mkt > 0 AS INTEGER)) OVER w AS x1 FROM r JOIN m USING (ts) WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
c AS (SELECT symbol, y, y1, x1, count(*) AS n FROM s WHERE y1 IS NOT NULL GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY symbol) AS t, sum(n) OVER (PARTITION BY symbol, y1, x1) AS n_yx, sum(n) OVER (PARTITION BY symbol, y, y1) AS n_yy, sum(n) OVER (PARTITION BY symbol, y1) AS n_y FROM c)
SELECT symbol, sum(n / t * ln(n * n_y / (n_yx * n_yy))) AS te FROM p GROUP BY symbol""", "te", "symbol")
def transfer_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Information that the sign of last week's market return adds about the sign of a symbol's."""
    r = _weekly_returns(spark, sf).select("symbol", "ts", "ret")
    j = r.join(r.groupBy("ts").agg(F.avg("ret").alias("mkt")), "ts").where("ret IS NOT NULL").withColumns(
        {"y": (F.col("ret") > 0).cast("int"), "x": (F.col("mkt") > 0).cast("int")}
    )
    s = j.select("symbol", "y", S.lagged("y").alias("y1"), S.lagged("x").alias("x1")).where("y1 IS NOT NULL")
    c = s.groupBy("symbol", "y", "y1", "x1").agg(F.count("*").alias("n"))
    over = lambda *k: F.sum("n").over(W.partitionBy("symbol", *k))
    return c.withColumn(
        "t", F.col("n") / over() * F.log(F.col("n") * over("y1") / (over("y1", "x1") * over("y", "y1")))
    ).groupBy("symbol").agg(F.sum("t").alias("te"))
