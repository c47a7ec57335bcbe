"""State machines, microstructure and timed exposures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions import series as S
from riverbed.operators import backtest as B
from riverbed.operators import stateful as T
from riverbed.plans.backtests import GENTLE, METRICS, evaluated, gentle
from riverbed.plans.panel_ops import HOURS, PAIRS, WITH_C, consecutive_spreads, hourly
from riverbed.plans.registry import query
from riverbed.plans.research import DRETS, WITH_D, WITH_T, _daily_returns, _levels
from riverbed.sources import panels as P


def fold(key: str, table: str, value: str, body: str, start: str = "0.0") -> str:
    """CTEs lists and states: a fold over a key's rows in SQL, from which each prefix is worked out anew; s is the state before, x the row's value."""
    return f"""lists AS (SELECT {key}, list({value} ORDER BY ts) AS v, list(ts ORDER BY ts) AS t FROM {table} GROUP BY ALL),
states AS (SELECT {key}, t[i] AS ts, list_reduce(list_prepend({start}, v[:i]), lambda s, x: {body}) AS s FROM lists, unnest(generate_series(1, len(v))) AS g(i))"""


_EMA = """lists AS (SELECT symbol, list(spread ORDER BY ts) AS v, list(ts ORDER BY ts) AS t FROM sp GROUP BY symbol),
em AS (SELECT symbol, t[i] AS ts, list_reduce(v[:i], lambda a, x: 0.1 * x + 0.9 * a) AS e FROM lists, unnest(generate_series(1, len(v))) AS g(i))"""


@query(f"""{WITH_C}, sp AS (SELECT symbol, ts, avg((fut / spot - 1) * 365 / greatest(dte, 1)) - any_value(funding) * 1095 AS spread FROM contracts JOIN (SELECT symbol, ts, funding FROM daily) d USING (symbol, ts) WHERE dte BETWEEN 5 AND 85 GROUP BY 1, 2), {_EMA},
k AS (SELECT symbol, ts, lag(e) OVER (PARTITION BY symbol ORDER BY ts) AS e FROM em)
SELECT symbol, ts, CASE WHEN e IS NULL THEN 0 ELSE CAST(coalesce(last_value(CASE WHEN e > 0.4 THEN 1 WHEN e < -0.4 THEN -1 WHEN abs(e) < 0.2 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), 0) AS INTEGER) END AS state FROM k""", "", "symbol ts state")
def term_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    """Basis less funding, both a year, smoothed and known a bar before: in beyond a threshold, out inside half of it; a bar without a value is flat and keeps the state."""
    d = P.daily(spark, sf).select("symbol", "ts", "funding")
    ann = P.contracts(spark, sf).where("dte BETWEEN 5 AND 85").groupBy("symbol", "ts").agg(
        F.avg(F.expr("(fut / spot - 1) * 365 / greatest(dte, 1)")).alias("ann")
    )
    e = T.ewm(
        ann.join(d, ["symbol", "ts"]).withColumn("spread", F.expr("ann - funding * 1095")), ["symbol"], "spread", 19, "v"
    ).withColumn("e", S.lagged("v"))
    state = T.latest(F.expr("CASE WHEN e > 0.4 THEN 1 WHEN e < -0.4 THEN -1 WHEN abs(e) < 0.2 THEN 0 END"))
    return e.withColumn("state", state).withColumn("state", F.expr("CASE WHEN e IS NULL THEN 0 ELSE state END"))


_PAIR = f"""{WITH_D}, lp AS (SELECT symbol, ts, ln(close) AS y FROM daily), pr AS (SELECT a.symbol || '/' || b.symbol AS pair, a.ts, a.y AS ya, b.y AS yb FROM lp a JOIN lp b ON a.ts = b.ts AND a.symbol < b.symbol),
cu AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) <= floor(count(*) OVER (PARTITION BY pair) * 0.6) AS ins FROM pr),
ft AS (SELECT pair, regr_slope(ya, yb) AS beta, regr_intercept(ya, yb) AS alpha FROM cu WHERE ins GROUP BY pair), rs AS (SELECT pair, ts, ins, ya - beta * yb - alpha AS e FROM cu JOIN ft USING (pair)),
sd AS (SELECT pair, avg(e) AS m, stddev_samp(e) AS d FROM rs WHERE ins GROUP BY pair), zs AS (SELECT pair, ts, round((e - m) / d, 9) AS z FROM rs JOIN sd USING (pair) WHERE d > 0)"""


def hedged_scores(spark: SparkSession, sf: str) -> DataFrame:
    """pair, ts, z: the residual of one log price on another, hedge, mean and deviation from the first part alone."""
    lp = P.daily(spark, sf).select("symbol", "ts", F.log("close").alias("y"))
    pr = lp.withColumnsRenamed({"symbol": "a", "y": "ya"}).join(
        lp.withColumnsRenamed({"symbol": "b", "y": "yb"}), "ts"
    ).where("a < b").withColumn("pair", F.concat_ws("/", "a", "b"))
    cut = B.split(pr, ["pair"])
    fit = cut.where("split = 'is'").groupBy("pair").agg(F.regr_slope("ya", "yb").alias("beta"), F.regr_intercept("ya", "yb").alias("alpha"))
    e = cut.join(fit, "pair").withColumn("e", F.expr("ya - beta * yb - alpha"))
    sd = e.where("split = 'is'").groupBy("pair").agg(F.avg("e").alias("m"), F.stddev_samp("e").alias("d")).where("d > 0")
    return e.join(sd, "pair").select("pair", "ts", F.round(F.expr("(e - m) / d"), 9).alias("z"), "ya", "yb", "beta")


@query(f"""{_PAIR}, {fold("pair", "zs", "z", "CASE WHEN x IS NULL THEN s WHEN s = 0 THEN CASE WHEN x > 2 THEN -1.0 WHEN x < -2 THEN 1.0 ELSE 0.0 END WHEN s * x > -0.5 THEN 0.0 ELSE s END")}
SELECT pair, ts, CAST(s AS INTEGER) AS state FROM states""", "", "pair ts state")
def pair_state(spark: SparkSession, sf: str) -> DataFrame:
    """Hedged pairs: short above two deviations, long below, out at half a one, never straight across."""
    return T.pair_position(hedged_scores(spark, sf), ["pair"], "z")


_TIMED = "CASE WHEN {0} x <> 0 THEN x * {1} WHEN abs(s) <= 1 THEN {2} ELSE sign(s) * (abs(s) - 1) END"
_CASCADE = f"""{WITH_T}, hb AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_max(price, (ts, seq)) AS close, sum(qty) AS oi, sum(CASE WHEN maker THEN -qty ELSE qty END) / sum(qty) AS taker FROM ticks GROUP BY 1, 2),
hr AS (SELECT symbol, ts, taker, close / lag(close) OVER w - 1 AS ret, oi - lag(oi) OVER w AS doi FROM hb WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
hq AS (SELECT *, count(doi) OVER t AS k, quantile_cont(doi, 0.2) OVER t AS lowest FROM hr WINDOW t AS (PARTITION BY symbol ORDER BY ts ROWS 71 PRECEDING)),
cs AS (SELECT symbol, ts, CASE WHEN k >= 24 AND doi <= lowest AND abs(ret) >= 0.2 THEN CASE WHEN ret < 0 AND taker < 0.5 THEN 1.0 WHEN ret > 0 AND taker > -0.5 THEN -1.0 ELSE 0.0 END ELSE 0.0 END AS x FROM hq)"""


def cascades(spark: SparkSession, sf: str, least_move: float = 0.2) -> DataFrame:
    """symbol, ts, x: -1 or 1 against a sharp move on an hour in which open interest falls among its lowest fifth of 72 hours."""
    hb = P.ticks(spark, sf).groupBy("symbol", F.date_trunc("hour", "ts").alias("bar")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("qty").alias("oi"),
        (F.sum(F.when(F.col("maker"), -F.col("qty")).otherwise(F.col("qty"))) / F.sum("qty")).alias("taker")
    )
    hr = hb.withColumnRenamed("bar", "ts").withColumns({"ret": F.col("close") / S.lagged("close") - 1, "doi": F.col("oi") - S.lagged("oi")})
    hq = hr.withColumn("lowest", S.rolling(lambda c: F.percentile(c, F.lit(0.2)), 72, "doi", least=24))
    hit = f"doi <= lowest AND abs(ret) >= {least_move}D"
    return hq.select(
        "symbol", "ts", "ret",
        F.expr(f"CASE WHEN {hit} AND ret < 0 AND taker < 0.5 THEN 1.0D WHEN {hit} AND ret > 0 AND taker > -0.5 THEN -1.0D ELSE 0.0D END").alias("x")
    )


@query(f"""{_CASCADE}, {fold("symbol", "cs", "x", _TIMED.format("abs(s) <= 1 AND", 6, "0.0"))}
SELECT symbol, ts, CAST(sign(s) AS INTEGER) AS state FROM states""", "", "symbol ts state")
def cascade_fade(spark: SparkSession, sf: str) -> DataFrame:
    """Six bars against each cascade; those that come meanwhile are ignored."""
    return T.timed_position(cascades(spark, sf), ["symbol"], "x", 6, False)


@query(f"""{_CASCADE}, neg AS (SELECT symbol, ts, -x AS x FROM cs), {fold("symbol", "neg", "x", _TIMED.format("", 6, "0.0"))}
SELECT symbol, ts, CAST(sign(s) AS INTEGER) AS state FROM states""", "", "symbol ts state")
def cascade_ride(spark: SparkSession, sf: str) -> DataFrame:
    """Six bars along each cascade, begun anew by the next."""
    return T.timed_position(cascades(spark, sf).withColumn("x", -F.col("x")), ["symbol"], "x", 6, True)


@query(f"""{_CASCADE}, {fold("symbol", "cs", "x", _TIMED.format("abs(s) <= 1 AND", 6, "0.0"))}, jn AS (SELECT symbol, ts, sign(s) AS pos, ret FROM states JOIN hr USING (symbol, ts)), pn AS (SELECT symbol, ts, lag(pos, 1, 0) OVER w * coalesce(ret, 0) - abs(lag(pos, 1, 0) OVER w - lag(pos, 2, 0) OVER w) * 5 / 1e4 AS net, lag(pos, 1, 0) OVER w AS p, lag(pos, 2, 0) OVER w AS p0 FROM jn WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT ts, avg(net) AS net, CAST(sum(CASE WHEN p <> 0 AND p0 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS events FROM pn GROUP BY ts""", "net", "ts events")
def cascade_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The mean over symbols of what cascade positions earn a bar later, and how many begin."""
    c = cascades(spark, sf)
    j = T.timed_position(c, ["symbol"], "x", 6, False).join(c.select("symbol", "ts", "ret"), ["symbol", "ts"])
    j = j.withColumn("p", S.lagged("state", 1, 0)).withColumn("p0", S.lagged("state", 2, 0))
    return j.groupBy("ts").agg(
        F.avg(F.expr("p * coalesce(ret, 0.0D) - abs(p - p0) * 5 / 1e4D")).alias("net"), F.count_if(F.expr("p <> 0 AND p0 = 0")).alias("events")
    )


@query(None)
def kalman_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Hedges that follow a random walk, and the machine on the standardised surprise."""
    k = T.kalman_hedge(hedged_scores(spark, sf), ["pair"], "yb", "ya")
    w = W.partitionBy("pair").orderBy("ts").rowsBetween(-29, 0)
    z = k.withColumn(
        "z",
        F.when(
            (F.count("resid").over(w) >= 30) & (F.stddev_samp("resid").over(w) > 0),
            (F.col("resid") - F.avg("resid").over(w)) / F.stddev_samp("resid").over(w)
        )
    )
    return T.pair_position(z, ["pair"], "z").join(k, ["pair", "ts"])


_SCORE = f"""{DRETS}, zz AS (SELECT symbol, ts, round((close - avg(close) OVER t) / nullif(stddev_samp(close) OVER t, 0), 9) AS s, count(close) OVER t >= 20 AS ok FROM r WINDOW t AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING)), xs AS (SELECT symbol, ts, CASE WHEN ok THEN s END AS s FROM zz)"""


@query(f"""{_SCORE}, {fold("symbol", "xs", "s", "CASE WHEN x IS NULL THEN 0.0 WHEN s = 0 THEN CASE WHEN x < -1.25 THEN 1.0 WHEN x > 1.25 THEN -1.0 ELSE 0.0 END WHEN abs(x) < 0.5 THEN 0.0 ELSE s END")},
dm AS (SELECT symbol, ts, s, s - avg(s) OVER (PARTITION BY ts) AS d FROM states)
SELECT symbol, ts, CAST(s AS INTEGER) AS state, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY ts), 0), 0) AS weight FROM dm""", "weight", "symbol ts state")
def score_states(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of reverting scores, ineligible names flat, then demeaned over names to gross one."""
    w = S.trailing(30)
    z = _daily_returns(spark, sf).select(
        "symbol", "ts", F.round(F.try_divide(F.col("close") - F.avg("close").over(w), F.stddev_samp("close").over(w)), 9).alias("s"),
        (F.count("close").over(w) >= 20).alias("ok")
    )
    st = T.score_book(z, ["symbol"])
    dm = st.withColumn("d", F.col("state") - F.avg("state").over(S.by_time()))
    return dm.withColumn("weight", F.coalesce(F.try_divide("d", F.sum(F.abs("d")).over(S.by_time())), F.lit(0.0)))


@query(None)
def band_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Baskets of the two best and two worst by weekly funding; members stay while they rank within one place more. A side's names are the universe, one row a week."""
    weekly = P.daily(spark, sf).groupBy("symbol", F.next_day(F.date_sub("ts", 1), "FRI").alias("ts")).agg(F.sum("funding").alias("f"))
    listed = lambda order, cond: F.transform(
        F.array_sort(F.collect_list(F.when(F.expr(cond), F.struct(order.alias("o"), "symbol")))), lambda x: x["symbol"]
    )
    sides = weekly.groupBy("ts").agg(listed(F.col("f"), "f > 0").alias("high"), listed(-F.col("f"), "f < 0").alias("low"))
    ranks = sides.select(
        "ts",
        F.inline(
            F.array(
                F.struct(F.lit("long").alias("side"), F.col("low").alias("names")),
                F.struct(F.lit("short").alias("side"), F.col("high").alias("names"))
            )
        )
    )
    members = T.band_basket(ranks, ["side"], 2, 1)
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    return members.select("ts", "side", F.explode("members").alias("symbol"), (sign / F.size("members")).alias("weight"))


# ---- ticks


@query(None)
def volume_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """The mean imbalance of the last fifty of volume buckets, each a fiftieth of all volume; null where there are fewer. Per symbol and bucket, not per tick."""
    b = P.ticks(spark, sf).groupBy("symbol", F.window("ts", "1 minute").start.alias("bar")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("qty").alias("volume")
    ).withColumnRenamed("bar", "ts")
    d = b.withColumn("d", F.coalesce(F.col("close") - S.lagged("close"), F.lit(0.0)))
    s = d.groupBy("symbol").agg((F.sum("volume") / 50).alias("limit"), (F.stddev_pop("d") + 1e-9).alias("sd"))
    closed = T.volume_buckets(d.join(s, "symbol").withColumn("z", F.col("d") / F.col("sd")), ["symbol"]).where("bucket IS NOT NULL")
    n = F.count("*").over(W.partitionBy("symbol"))
    last = closed.withColumn("n", n).groupBy("symbol").agg(
        F.first("n").alias("buckets"), F.avg(F.expr("CASE WHEN bucket >= n - 50 THEN imbalance END")).alias("vpin")
    )
    return last.select("symbol", "buckets", F.expr("CASE WHEN buckets >= 50 THEN vpin END").alias("vpin"))


@query(None)
def maker_simulation(spark: SparkSession, sf: str) -> DataFrame:
    """A passive quoter with and without a skew against order flow: what it earns by spread, rebate and inventory."""
    side = lambda m: F.sum(F.when(F.col("maker") == m, F.col("qty")).otherwise(0.0))
    b = P.ticks(spark, sf).groupBy("symbol", F.window("ts", "5 seconds").start.alias("bar")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("mid"), side(True).alias("sell_agg"), side(False).alias("buy_agg")
    ).withColumnRenamed("bar", "ts")
    flow = b.withColumn(
        "f", F.when(F.row_number().over(S.by_symbol()) >= 12, F.avg(F.col("buy_agg") - F.col("sell_agg")).over(S.trailing(12)))
    ).withColumns({"ofi": F.coalesce(S.lagged("f"), F.lit(0.0)), "next_mid": F.lead("mid").over(S.by_symbol())})
    sd = flow.where("ofi <> 0").groupBy("symbol").agg((F.stddev_pop("ofi") + 1e-9).alias("sd"))
    z = flow.join(sd, "symbol").withColumn("z", F.col("ofi") / F.col("sd"))
    arms = [T.market_maker(z, ["symbol"], skew, 0.5, -0.5, 0.1, 50.0).withColumn("skew", F.lit(skew)) for skew in (0.0, 1.0)]
    both = arms[0].unionByName(arms[1])
    total = F.sum(F.expr("spread + fee + adverse"))
    return both.groupBy("symbol", "skew").agg(
        F.count("*").alias("bars"), *[F.sum(c).alias(c) for c in ("spread", "fee", "adverse")], total.alias("total"),
        F.max(F.abs("inventory")).alias("most_inventory")
    )


OFI = f"""{WITH_T}, ob AS (SELECT symbol, date_trunc('minute', ts) AS ts, arg_max(price, (ts, seq)) AS close, sum(CASE WHEN maker THEN -qty ELSE qty END) / sum(qty) AS ofi FROM ticks GROUP BY 1, 2),
oh AS (SELECT symbol, h, ts, ln(lead(close) OVER w / close) AS r1, ln(lead(close, CAST(h AS INTEGER)) OVER w / close) AS fwd, ofi, row_number() OVER w AS rn FROM ob, (SELECT unnest([1, 5, 15]) AS h) WINDOW w AS (PARTITION BY symbol, h ORDER BY ts)),
om AS (SELECT *, CASE h WHEN 1 THEN ofi WHEN 5 THEN avg(ofi) OVER (PARTITION BY symbol, h ORDER BY ts ROWS 4 PRECEDING) ELSE avg(ofi) OVER (PARTITION BY symbol, h ORDER BY ts ROWS 14 PRECEDING) END AS m FROM oh),
os AS (SELECT *, lag(CASE WHEN rn >= h THEN m END) OVER (PARTITION BY symbol, h ORDER BY ts) AS sig FROM om)"""


def flow_signals(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, h, ts, rn, r1, fwd, sig: mean order flow of h minutes as known a minute before, and returns over one and h minutes.

    A price of zero makes a return infinite, and two make one that is no number; both stay rows, as they do in SQL.
    """
    signed = F.when(F.col("maker"), -F.col("qty")).otherwise(F.col("qty"))
    b = P.ticks(spark, sf).groupBy("symbol", F.window("ts", "1 minute").start.alias("bar")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("close"), S.quotient(F.sum(signed), F.sum("qty")).alias("ofi")
    ).withColumnRenamed("bar", "ts")
    by, ahead = S.by_symbol(), lambda k: S.logarithm(S.quotient(F.lead("close", k).over(S.by_symbol()), F.col("close")))
    b = b.withColumns(
        {
            "rn": F.row_number().over(by), "r1": ahead(1), **{f"f{h}": ahead(h) for h in (1, 5, 15)},
            **{f"m{h}": F.avg("ofi").over(S.trailing(h)) for h in (1, 5, 15)}
        }
    )
    b = b.withColumns({f"s{h}": F.lag(F.when(F.col("rn") >= h, F.col(f"m{h}"))).over(by) for h in (1, 5, 15)})
    grid = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"f{h}").alias("fwd"), F.col(f"s{h}").alias("sig")) for h in (1, 5, 15)])
    return b.select("symbol", "ts", "rn", "r1", F.inline(grid))


@query(f"""{OFI}, ok AS (SELECT *, row_number() OVER (PARTITION BY symbol, h ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM os WHERE sig IS NOT NULL AND fwd IS NOT NULL), tot AS (SELECT symbol, count(*) AS bars FROM ob GROUP BY symbol)
SELECT symbol, h, count(*) AS n, corr(sig, fwd) AS ic FROM ok JOIN tot USING (symbol) WHERE k > floor(bars * 0.6) GROUP BY 1, 2 HAVING count(*) > 50""", "ic", "symbol h n")
def flow_ic(spark: SparkSession, sf: str) -> DataFrame:
    """How order flow foretells the return over h minutes, after a cut that counts rows with both."""
    s = flow_signals(spark, sf)
    total = s.where("h = 1").groupBy("symbol").agg(F.count("*").alias("bars"))
    ok = s.where("sig IS NOT NULL AND fwd IS NOT NULL").withColumn(
        "k", F.row_number().over(W.partitionBy("symbol", "h").orderBy("ts"))
    ).join(total, "symbol").where("k > floor(bars * 0.6)")
    # corr raises where a side is constant
    ic = S.quotient(F.covar_pop("sig", "fwd"), F.stddev_pop("sig") * F.stddev_pop("fwd"))
    return ok.groupBy("symbol", "h").agg(F.count("*").alias("n"), ic.alias("ic")).where("n > 50")


@query(f"""{OFI}, hp AS (SELECT symbol, h, ts, r1, last_value(CASE WHEN (rn - 1) % h = 0 THEN coalesce(sign(sig), 0) END IGNORE NULLS) OVER (PARTITION BY symbol, h ORDER BY ts) AS pos FROM os),
fe AS (SELECT *, pos * r1 / 100 - abs(pos - lag(pos, 1, 0) OVER (PARTITION BY symbol, h, fee ORDER BY ts)) * fee / 1e4 AS net0 FROM hp, (SELECT unnest([0.0, 1.8, 4.5]) AS fee)),
nets AS (SELECT symbol || '/' || h || '/' || fee AS name, 525600 AS ppy, ts, pos, net0 AS net, CASE WHEN row_number() OVER (PARTITION BY symbol, h, fee ORDER BY ts) <= floor(count(*) OVER (PARTITION BY symbol, h, fee) * 0.6) THEN 'is' ELSE 'oos' END AS split, symbol, h, fee FROM fe WHERE net0 IS NOT NULL), {METRICS}, kk AS (SELECT DISTINCT name, symbol, h, fee FROM nets)
SELECT symbol, h, fee, n, sharpe_ann, turnover FROM met JOIN kk USING (name) WHERE split = 'oos'""", "fee sharpe_ann:4 turnover", "symbol h n")
def flow_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """The sign of order flow held for h minutes, by fee; a hundredth of the return, so that it compounds."""
    per = W.partitionBy("symbol", "h").orderBy("ts")
    held = F.last(F.expr("CASE WHEN (rn - 1) % h = 0 THEN coalesce(signum(nanvl(sig, 0.0D)), 0.0D) END"), True).over(per.rowsBetween(W.unboundedPreceding, 0))
    hp = flow_signals(spark, sf).withColumn("pos", held).withColumn("turn", F.abs(F.col("pos") - F.lag(F.col("pos"), 1, 0.0).over(per)))
    fe = hp.withColumn(
        "fee", F.explode(F.array(*[F.lit(x) for x in (0.0, 1.8, 4.5)]))
    ).withColumn("net", F.expr("pos * r1 / 100 - turn * fee / 1e4D")).where("net IS NOT NULL")
    return evaluated(fe.select("symbol", "h", "fee", "ts", "pos", "net"), ["symbol", "h", "fee"], 525600, True).where("split = 'oos'")


# ---- timed exposures


@query(f"""{GENTLE}, v AS (SELECT symbol, ts, ret, px / lag(px, 30) OVER w - 1 AS trail, CASE WHEN count(*) OVER t >= 20 THEN stddev_samp(ret) OVER t END AS vol FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts), t AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING)),
md AS (SELECT symbol, quantile_cont(vol, 0.5) AS target FROM v WHERE vol > 0 GROUP BY symbol)
SELECT symbol, ts, coalesce(sign(lag(trail) OVER w), 0) AS raw, coalesce(greatest(-3, least(3, lag(sign(trail) * target / nullif(vol, 0)) OVER w)), 0) AS scaled FROM v JOIN md USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY ts)""", "raw scaled", "symbol ts")
def scaled_momentum(spark: SparkSession, sf: str) -> DataFrame:
    """Sign of the past month, plain and brought to the median volatility, within three times."""
    v = gentle(spark, sf).select(
        "symbol", "ts", "ret", (F.col("px") / F.lag("px", 30).over(S.by_symbol()) - 1).alias("trail"),
        F.when(F.count("*").over(S.trailing(30)) >= 20, F.stddev_samp("ret").over(S.trailing(30))).alias("vol")
    )
    md = v.where("vol > 0").groupBy("symbol").agg(F.percentile("vol", F.lit(0.5)).alias("target"))
    j = v.join(md, "symbol").withColumns({"a": F.signum("trail"), "b": F.expr("signum(trail) * target / nullif(vol, 0)")})
    return j.select(
        "symbol", "ts", F.coalesce(S.lagged("a"), F.lit(0.0)).alias("raw"),
        F.coalesce(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), S.lagged("b"))), F.lit(0.0)).alias("scaled")
    )


@query(None)
def momentum_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """Momentum plain, scaled by volatility, and only while the Hurst exponent of the last 150 days, renewed every ten, is above a half: metrics of each arm that trades."""
    from riverbed.functions.kernels import hurst

    g = gentle(spark, sf).select("symbol", "ts", "ret")
    h = T.rolling_apply(g, ["symbol"], ["ret"], 150, 10, lambda x: (hurst(x),), "hurst double")
    j = scaled_momentum(spark, sf).join(g, ["symbol", "ts"]).join(h, ["symbol", "ts"])
    j = j.withColumn("gated", F.expr("CASE WHEN hurst > 0.5 THEN raw ELSE 0.0D END")).withColumn("gated", F.coalesce(S.lagged("gated"), F.lit(0.0)))
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("pos")) for a in ("raw", "scaled", "gated")])
    rows = j.select("symbol", "ts", "ret", F.inline(arms))
    turn = F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(W.partitionBy("symbol", "arm").orderBy("ts")))
    return evaluated(rows.withColumn("net", F.col("pos") * F.col("ret") - turn * 5 / 1e4), ["symbol", "arm"], 365)


@query(f"""{GENTLE}, v AS (SELECT symbol, ts, ret, CASE WHEN count(*) OVER t >= 24 THEN stddev_samp(ret) OVER t END AS rv FROM g WINDOW t AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)),
md AS (SELECT symbol, quantile_cont(rv, 0.5) AS mid FROM v WHERE rv > 0 GROUP BY symbol), f AS (SELECT symbol, ts, ret, coalesce(rv, mid) AS rv, mid FROM v JOIN md USING (symbol)),
z AS (SELECT *, ln(rv) AS lr, (ln(rv) - avg(ln(rv)) OVER t) / nullif(stddev_samp(ln(rv)) OVER t, 0) AS z FROM f WHERE rv > 0 WINDOW t AS (PARTITION BY symbol ORDER BY ts ROWS 71 PRECEDING))
SELECT symbol, ts, lag(greatest(0.2, least(3, mid / rv)), 1, 1) OVER w AS inverse, lag(CASE WHEN z > 1 THEN 0.3 WHEN z < -1 THEN 1.5 ELSE 1.0 END, 1, 1) OVER w AS stepped FROM z WINDOW w AS (PARTITION BY symbol ORDER BY ts)""", "inverse stepped", "symbol ts")
def volatility_timed(spark: SparkSession, sf: str) -> DataFrame:
    """Exposure by the inverse of realised volatility, and in steps of its score, both known a day before."""
    v = gentle(spark, sf).select(
        "symbol", "ts", F.when(F.count("*").over(S.trailing(24)) >= 24, F.stddev_samp("ret").over(S.trailing(24))).alias("rv")
    )
    md = v.where("rv > 0").groupBy("symbol").agg(F.percentile("rv", F.lit(0.5)).alias("mid"))
    f = v.join(md, "symbol").withColumn("rv", F.coalesce("rv", "mid")).where("rv > 0").withColumn("lr", F.log("rv"))
    z = f.withColumn("z", F.try_divide(F.col("lr") - F.avg("lr").over(S.trailing(72)), F.stddev_samp("lr").over(S.trailing(72))))
    z = z.withColumns(
        {"a": F.expr("greatest(0.2D, least(3.0D, mid / rv))"), "b": F.expr("CASE WHEN z > 1 THEN 0.3D WHEN z < -1 THEN 1.5D ELSE 1.0D END")}
    )
    return z.select("symbol", "ts", S.lagged("a", 1, 1.0).alias("inverse"), S.lagged("b", 1, 1.0).alias("stepped"))


_HOUR_POS = f"""{HOURS}, cu AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) <= floor(count(*) OVER (PARTITION BY symbol) * 0.6) AS ins FROM hr WHERE ret IS NOT NULL),
tb AS (SELECT h, avg(ret) AS m, count(*) AS n FROM cu WHERE ins GROUP BY h HAVING count(*) > 30), tk AS (SELECT h, sign(m) AS s, row_number() OVER (ORDER BY abs(round(m, 12)) DESC, h) AS place FROM tb)"""


@query(f"""{_HOUR_POS}, po AS (SELECT symbol, ts, ins, ret, k, CASE WHEN place <= k THEN s ELSE 0 END AS pos FROM cu LEFT JOIN tk USING (h), (SELECT unnest([1, 2, 3, 6]) AS k))
SELECT k, count(*) FILTER (coalesce(pos, 0) <> 0) AS active, sum(coalesce(pos, 0) * ret) AS gross FROM po WHERE NOT ins GROUP BY k""", "gross", "k active")
def hour_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """The k hours with the largest mean in sample, held by its sign afterwards."""
    cu = B.split(hourly(spark, sf).where("ret IS NOT NULL"), ["symbol"])
    tb = cu.where("split = 'is'").groupBy("h").agg(F.avg("ret").alias("m"), F.count("*").alias("n")).where("n > 30")
    tk = tb.select("h", F.signum("m").alias("s"), F.row_number().over(W.orderBy(F.abs(F.round("m", 12)).desc(), "h")).alias("place"))
    po = cu.where("split = 'oos'").join(F.broadcast(tk), "h", "left").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3, 6))))).withColumn(
        "pos", F.expr("CASE WHEN place <= k THEN s ELSE 0.0D END")
    )
    return po.groupBy("k").agg(F.count_if(F.expr("pos <> 0")).alias("active"), F.sum(F.col("pos") * F.col("ret")).alias("gross"))


@query(f"""{WITH_D}, l0 AS (SELECT symbol, ts, ln(close) AS s0 FROM daily), {_levels(3)}, dt AS (SELECT symbol, ts, s2 - s3 AS d FROM l3), nz AS (SELECT symbol, ts, d / nullif(CASE WHEN count(d) OVER t >= 20 THEN stddev_samp(d) OVER t END, 0) AS z FROM dt WINDOW t AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING))
SELECT symbol, ts, coalesce(lag(CASE WHEN abs(z) < 0.5 THEN 0 ELSE sign(z) END) OVER (PARTITION BY symbol ORDER BY ts), 0) AS pos FROM nz""", "pos", "symbol ts")
def wavelet_band(spark: SparkSession, sf: str) -> DataFrame:
    """The sign of one band of the causal decomposition, flat while it is small against its own volatility, a day later."""
    d = P.daily(spark, sf).select("symbol", "ts", F.log("close").alias("s0"))
    for j in range(3):
        d = d.withColumn(f"s{j + 1}", 0.5 * F.col(f"s{j}") + 0.5 * F.coalesce(S.lagged(f"s{j}", 2**j), F.first(f"s{j}").over(S.by_symbol())))
    d = d.withColumn("d", F.col("s2") - F.col("s3"))
    z = d.withColumn(
        "z", F.try_divide("d", S.rolling(F.stddev_samp, 60, "d", least=20))
    ).withColumn("p", F.expr("CASE WHEN abs(z) < 0.5 THEN 0.0D ELSE signum(z) END"))
    return z.select("symbol", "ts", F.coalesce(S.lagged("p"), F.lit(0.0)).alias("pos"))


@query(f"""{PAIRS}
SELECT symbol, near, CASE WHEN entry > 0.02 THEN -1 WHEN entry < -0.02 THEN 1 ELSE 0 END AS side, n FROM spreads""", "", "symbol near side n")
def calendar_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Which way each calendar spread would be held."""
    return consecutive_spreads(spark, sf).withColumn("side", F.expr("CASE WHEN entry > 0.02 THEN -1 WHEN entry < -0.02 THEN 1 ELSE 0 END"))
