"""Tests of series: memory, stationarity, lead and lag, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions import kernels as K
from riverbed.functions import series as S
from riverbed.operators import fits
from riverbed.operators.functional import per_series
from riverbed.plans.panel_ops import FEATURES, features
from riverbed.plans.registry import query
from riverbed.plans.research import DRETS, RETS, WITH_D, _daily_returns, _weekly_returns
from riverbed.sources import panels as P
from riverbed.sources.cache import kept

Q = 4
_E2 = ", ".join(f"sum(e2 * lag{j}) AS c{j}" for j in range(1, Q))
_THETA = " + ".join(f"pow(2.0 * ({Q} - {j}) / {Q}, 2) * c{j} / (s2 * s2 / n)" for j in range(1, Q))


@query(f"""{DRETS}, x AS (SELECT symbol, ts, ret, row_number() OVER w AS rn, avg(ret) OVER (PARTITION BY symbol) AS mu, count(*) OVER (PARTITION BY symbol) AS n, sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS {Q - 1} PRECEDING) AS sq FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
e AS (SELECT *, (ret - mu) ** 2 AS e2 FROM x), l AS (SELECT *, {", ".join(f"lag(e2, {j}) OVER (PARTITION BY symbol ORDER BY ts) AS lag{j}" for j in range(1, Q))} FROM e),
a AS (SELECT symbol, any_value(n) AS n, sum(e2) AS s2, sum(CASE WHEN rn >= {Q} THEN (sq - {Q} * mu) ** 2 END) AS v, {_E2} FROM l GROUP BY symbol HAVING any_value(n) >= {2 * Q + 2}),
z AS (SELECT symbol, n, v / ({Q} * (n - {Q} + 1) * (1 - {Q}.0 / n)) / (s2 / (n - 1)) AS vr, {_THETA} AS theta FROM a)
SELECT symbol, n, vr, (vr - 1) / sqrt(theta / n) AS z FROM z WHERE theta > 0""", "vr z", "symbol n")
def variance_ratio_robust(spark: SparkSession, sf: str) -> DataFrame:
    """Variance ratio of four bars, and its distance from one in deviations that allow for changing variance."""
    every = W.partitionBy("symbol")
    x = _daily_returns(spark, sf).where("ret IS NOT NULL").withColumns(
        {
            "rn": F.row_number().over(S.by_symbol()), "mu": F.avg("ret").over(every), "n": F.count("*").over(every),
            "sq": F.sum("ret").over(S.trailing(Q))
        }
    )
    e = x.withColumn("e2", F.expr("pow(ret - mu, 2)")).withColumns({f"lag{j}": F.lag("e2", j).over(S.by_symbol()) for j in range(1, Q)})
    a = e.groupBy("symbol").agg(
        F.first("n").alias("n"), F.sum("e2").alias("s2"), F.expr(f"sum(CASE WHEN rn >= {Q} THEN pow(sq - {Q} * mu, 2) END)").alias("v"),
        *[F.sum(F.col("e2") * F.col(f"lag{j}")).alias(f"c{j}") for j in range(1, Q)]
    )
    z = a.where(f"n >= {2 * Q + 2}").select(
        "symbol", "n", F.expr(f"v / ({Q} * (n - {Q} + 1) * (1 - {Q}.0D / n)) / (s2 / (n - 1))").alias("vr"), F.expr(_THETA).alias("theta")
    )
    return z.where("theta > 0").withColumn("z", F.expr("(vr - 1) / sqrt(theta / n)"))


_SCALE = "CAST(floor(pow(10, log10(8) + k * (log10(floor(n / 4)) - log10(8)) / 19) + 1e-9) AS BIGINT)"


@query(f"""{DRETS}, x AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n,
  ret - avg(ret) OVER (PARTITION BY symbol) AS d FROM r WHERE ret IS NOT NULL),
y AS (SELECT symbol, i, n, sum(d) OVER (PARTITION BY symbol ORDER BY i) AS y FROM x WHERE n >= 100),
sc AS (SELECT DISTINCT symbol, {_SCALE} AS s FROM (SELECT DISTINCT symbol, n FROM y), unnest(generate_series(0, 19)) AS q(k)),
sg AS (SELECT symbol, s, i // s AS seg, regr_syy(y, i) - pow(regr_sxy(y, i), 2) / regr_sxx(y, i) AS rss FROM y JOIN sc USING (symbol) WHERE i < n // s * s GROUP BY 1, 2, 3),
f AS (SELECT symbol, s, avg(sqrt(greatest(rss, 0) / s)) AS f FROM sg GROUP BY 1, 2)
SELECT symbol, regr_slope(ln(f), ln(s)) AS hurst, count(*) AS scales FROM f WHERE f > 0 GROUP BY symbol HAVING count(*) >= 4""", "hurst", "symbol scales")
def hurst_exponents(spark: SparkSession, sf: str) -> DataFrame:
    """Detrended fluctuation analysis of each symbol's returns: a row goes to one segment of each of twenty scales, a segment's line is a regression, all as aggregates."""
    every = W.partitionBy("symbol")
    x = _daily_returns(spark, sf).where("ret IS NOT NULL").withColumns({
        "i": F.row_number().over(S.by_symbol()) - 1, "n": F.count("*").over(every), "d": F.col("ret") - F.avg("ret").over(every)
    })
    y = x.where("n >= 100").select("symbol", "i", "n", F.sum("d").over(W.partitionBy("symbol").orderBy("i")).alias("y"))
    scales = F.expr(f"explode(array_distinct(transform(sequence(0, 19), k -> {_SCALE})))")
    seg = y.select("*", scales.alias("s")).where("i < n DIV s * s").groupBy("symbol", "s", F.expr("i DIV s").alias("seg"))
    rss = seg.agg((F.regr_syy("y", "i") - F.pow(F.regr_sxy("y", "i"), F.lit(2)) / F.regr_sxx("y", "i")).alias("rss"))
    f = rss.groupBy("symbol", "s").agg(F.avg(F.sqrt(F.greatest("rss", F.lit(0.0)) / F.col("s"))).alias("f")).where("f > 0")
    fit = f.groupBy("symbol").agg(F.regr_slope(F.log("f"), F.log(F.col("s").cast("double"))).alias("hurst"), F.count("*").alias("scales"))
    return fit.where("scales >= 4")


@query(f"""{DRETS}, nsym AS (SELECT count(DISTINCT symbol) AS k FROM r), days AS (SELECT ts FROM r WHERE ret IS NOT NULL GROUP BY ts HAVING count(*) = (SELECT k FROM nsym)),
x AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, ret FROM r WHERE ts IN (SELECT ts FROM days)),
c AS (SELECT a.symbol AS lead, b.symbol AS follow, l.lag, corr(a.ret, b.ret) AS rho, count(*) AS n FROM (SELECT unnest(generate_series(1, 6)) AS lag) l, x a JOIN x b ON a.symbol <> b.symbol AND b.i = a.i + l.lag GROUP BY 1, 2, 3 HAVING count(*) >= 20)
SELECT lead, follow, arg_max(lag, (abs(round(rho, 9)), -lag)) AS lag, arg_max(rho, (abs(round(rho, 9)), -lag)) AS rho FROM c GROUP BY 1, 2""", "rho", "lead follow lag")
def lead_lag(spark: SparkSession, sf: str) -> DataFrame:
    """For each ordered pair the lag, six at most, at which the first tells most about the second, over the days that all share."""
    r = _daily_returns(spark, sf).where("ret IS NOT NULL")
    k = r.agg(F.count_distinct("symbol").alias("k"))
    days = r.groupBy("ts").agg(F.count("*").alias("c")).join(F.broadcast(k), F.expr("c = k"), "left_semi")
    x = r.join(days, "ts", "left_semi").select("symbol", F.row_number().over(S.by_symbol()).alias("i"), "ret")
    led = x.select(
        F.col("symbol").alias("lead"), F.col("ret").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("lag"), "i"
    ).withColumn("i", F.col("i") + F.col("lag"))
    c = led.join(
        x.select(F.col("symbol").alias("follow"), F.col("ret").alias("b"), "i"), "i"
    ).where("lead <> follow").groupBy("lead", "follow", "lag").agg(F.corr("a", "b").alias("rho"), F.count("*").alias("n")).where("n >= 20")
    best = F.max_by(F.struct("lag", "rho"), F.struct(F.abs(F.round("rho", 9)), -F.col("lag"))).alias("b")
    return c.groupBy("lead", "follow").agg(best).select("lead", "follow", F.col("b.lag").cast("long").alias("lag"), "b.rho")


@query(None)
def unit_root(spark: SparkSession, sf: str) -> DataFrame:
    """Augmented Dickey-Fuller t of logarithmic closes, lags by information criterion, and the least order of differencing that passes on the first part."""
    grid = tuple(round(0.05 * k, 2) for k in range(21))

    def both(x):
        import numpy as np

        level = np.log(x)
        t, p = K.augmented_df(level)
        return t, p, K.least_d(level[: int(len(level) * 0.6)], grid, 1e-2), len(x)

    return per_series(P.daily(spark, sf), ["symbol"], ["close"], both, "t double, lags double, least_d double, n long")


_DF = "regr_slope(dc, lc) AS slope, regr_count(dc, lc) AS n, regr_sxx(dc, lc) AS sxx, regr_syy(dc, lc) AS syy, regr_sxy(dc, lc) AS sxy"
COINT = f"""{WITH_D}, lp AS (SELECT symbol, ts, ln(close) AS y FROM daily), pr AS (SELECT a.symbol AS a, b.symbol AS b, a.ts, a.y AS ya, b.y AS yb FROM lp a JOIN lp b ON a.ts = b.ts AND a.symbol <> b.symbol),
ft AS (SELECT a, b, regr_slope(ya, yb) AS beta, regr_intercept(ya, yb) AS alpha FROM pr GROUP BY 1, 2), rs AS (SELECT a, b, ts, ya - beta * yb - alpha AS e FROM pr JOIN ft USING (a, b)),
lg AS (SELECT a, b, lag(e) OVER w AS lc, e - lag(e) OVER w AS dc FROM rs WINDOW w AS (PARTITION BY a, b ORDER BY ts)), rg AS (SELECT a, b, {_DF} FROM lg GROUP BY 1, 2),
dft AS (SELECT a, b, n, slope / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t, CASE WHEN slope < 0 THEN ln(2) / -slope END AS hl FROM rg)"""


def cointegration(spark: SparkSession, sf: str) -> DataFrame:
    """a, b, n, t, hl of the residual of a on b for every ordered pair: regressions are aggregates, the residual is a join with one row a pair."""
    lp = P.daily(spark, sf).select("symbol", "ts", F.log("close").alias("y"))
    pr = lp.select("ts", F.col("symbol").alias("a"), F.col("y").alias("ya")).join(
        lp.select("ts", F.col("symbol").alias("b"), F.col("y").alias("yb")), "ts"
    ).where("a <> b")
    fit = pr.groupBy("a", "b").agg(F.regr_slope("ya", "yb").alias("beta"), F.regr_intercept("ya", "yb").alias("alpha"))
    w = W.partitionBy("a", "b").orderBy("ts")
    e = pr.join(fit, ["a", "b"]).withColumn(
        "e", F.expr("ya - beta * yb - alpha")
    ).withColumn("lc", F.lag("e").over(w)).withColumn("dc", F.col("e") - F.col("lc"))
    g = e.groupBy("a", "b").agg(
        *[
            f("dc", "lc").alias(n) for n,
            f in (("s", F.regr_slope), ("n", F.regr_count), ("sxx", F.regr_sxx), ("syy", F.regr_syy), ("sxy", F.regr_sxy))
        ]
    )
    return g.select(
        "a", "b", "n", F.expr("s / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)").alias("t"),
        F.expr("CASE WHEN s < 0 THEN ln(2) / -s END").alias("hl")
    )


@query(f"""{COINT}
SELECT x.a, x.b, x.n, x.t AS t_ab, y.t AS t_ba, x.hl AS hl_ab, y.hl AS hl_ba, coalesce(x.t < -3 AND y.t < -3 AND x.hl > 2 AND x.hl < 90 AND y.hl > 2 AND y.hl < 90, FALSE) AS passes FROM dft x JOIN dft y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""", "t_ab t_ba hl_ab hl_ba", "a b n passes")
def engle_granger(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose residual is stationary either way and reverts neither too fast nor too slowly."""
    d = cointegration(spark, sf)
    back = d.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("t").alias("t_ba"), F.col("hl").alias("hl_ba"))
    both = d.where("a < b").withColumnsRenamed({"t": "t_ab", "hl": "hl_ab"}).join(back, ["a", "b"])
    return both.withColumn(
        "passes", F.coalesce(F.expr("t_ab < -3 AND t_ba < -3 AND hl_ab > 2 AND hl_ab < 90 AND hl_ba > 2 AND hl_ba < 90"), F.lit(False))
    )


@query(f"""{DRETS}, v AS (SELECT symbol, ts, ln(sqrt(avg(ret * ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING))) AS lv, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM r WHERE ret IS NOT NULL),
l AS (SELECT symbol, lv, lag(lv) OVER (PARTITION BY symbol ORDER BY ts) AS l1 FROM v WHERE rn >= 24), g AS (SELECT symbol, count(lv) AS n, corr(lv, l1) AS acf1, regr_slope(lv - l1, l1) AS b FROM l GROUP BY symbol)
SELECT symbol, n, acf1, CASE WHEN b < 0 THEN ln(2) / -b END AS half_life FROM g""", "acf1 half_life", "symbol n")
def volatility_reversion(spark: SparkSession, sf: str) -> DataFrame:
    """How the logarithm of realised volatility over 24 bars returns to its mean."""
    v = _daily_returns(spark, sf).where("ret IS NOT NULL").select(
        "symbol", "ts", F.row_number().over(S.by_symbol()).alias("rn"),
        F.log(F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(S.trailing(24)))).alias("lv")
    ).where("rn >= 24")
    g = v.withColumn("l1", S.lagged("lv")).groupBy("symbol").agg(
        F.count("lv").alias("n"), F.corr("lv", "l1").alias("acf1"), F.regr_slope(F.col("lv") - F.col("l1"), F.col("l1")).alias("b")
    )
    return g.select("symbol", "n", "acf1", F.expr("CASE WHEN b < 0 THEN ln(2) / -b END").alias("half_life"))


@query(None)
def ridge_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of tomorrow's return on the nine features: sums on the cluster, a small system on the driver."""
    w = fits.ridge(features(spark, sf), list(FEATURES), "fwd", 10.0)
    return spark.createDataFrame([(c, float(v)) for c, v in zip([*FEATURES, "intercept"], w, strict=True)], "feature string, coefficient double")


@query(None)
def logistic_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of the sign of tomorrow's return on the nine features, by Newton steps of one aggregate each."""
    # each step reads the table again, so it is made once
    f = kept(features(spark, sf).withColumn("up", (F.col("fwd") > 0).cast("double")).select(*FEATURES, "up"))
    w = fits.logistic(f, list(FEATURES), "up", 1.0)
    return spark.createDataFrame([(c, float(v)) for c, v in zip([*FEATURES, "intercept"], w, strict=True)], "feature string, coefficient double")


@query(f"""{RETS}, x AS (SELECT symbol, ts, ret, close, lag(ret) OVER w AS l1, lag(ret, 2) OVER w AS l2 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT count(*) AS n, sum(l1 * l1) AS a, sum(l1 * l2) AS b, sum(l2 * l2) AS c, sum(l1) AS p, sum(l2) AS q, sum(l1 * ret) AS u, sum(l2 * ret) AS v, sum(ret) AS y FROM x WHERE ret IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL),
m AS (SELECT n, a - p * p / n + 10 AS a, b - p * q / n AS b, c - q * q / n + 10 AS c, u - p * y / n AS u, v - q * y / n AS v FROM g)
SELECT n, (u * c - v * b) / (a * c - b * b) AS w1, (a * v - b * u) / (a * c - b * b) AS w2 FROM m""", "w1 w2", "n")
def ridge_two_lags(spark: SparkSession, sf: str) -> DataFrame:
    """The return on its two predecessors, penalty ten, intercept free."""
    x = _weekly_returns(spark, sf).withColumns({"l1": S.lagged("ret"), "l2": S.lagged("ret", 2)}).dropna(subset=["ret", "l1", "l2"])
    w = fits.ridge(x, ["l1", "l2"], "ret", 10.0)
    return x.agg(F.count("*").alias("n")).select("n", F.lit(float(w[0])).alias("w1"), F.lit(float(w[1])).alias("w2"))
