"""Books, costs, selection and validation: the battery in full, and the rules by which results are judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions import series as S
from riverbed.functions.probability import benchmark, benchmark_sql, normal_cdf_sql
from riverbed.operators import backtest as B
from riverbed.operators import books, validation
from riverbed.plans.registry import query
from riverbed.plans.research import RETS, WITH_D, _weekly_returns
from riverbed.sources import panels as P

#: Weekly weights of demeaned ranks of the last return, and the returns they earn.
WEIGHTS = f"""{RETS}, rk AS (SELECT symbol, ts, ret, fwd, rank() OVER (PARTITION BY ts ORDER BY ret) + (count(*) OVER (PARTITION BY ts, ret) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY ts) AS n FROM r WHERE ret IS NOT NULL),
dm AS (SELECT *, rk - avg(rk) OVER (PARTITION BY ts) AS d FROM rk), wt AS (SELECT symbol, ts, ret, coalesce(fwd, 0) AS fwd, CASE WHEN n >= 2 THEN coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY ts), 0), 0) ELSE 0 END AS w FROM dm),
lw AS (SELECT *, lag(w, 1, 0) OVER s AS w1, lag(w, 2, 0) OVER s AS w2, row_number() OVER s AS rn FROM wt WINDOW s AS (PARTITION BY symbol ORDER BY ts))"""


def weights(spark: SparkSession, sf: str) -> DataFrame:
    return books.rank_weights(_weekly_returns(spark, sf).where("ret IS NOT NULL").select("symbol", "ts", "ret", "fwd"), "ret")


@query(f"""{WEIGHTS}
SELECT ts, sum(w * fwd) - 5 / 1e4 * sum(abs(w - w1)) AS plain, sum(w1 * fwd) - 5 / 1e4 * sum(abs(w1 - w2)) AS lagged, sum(w1 * ret) - 5 / 1e4 * sum(CASE WHEN rn = 1 THEN 0 ELSE abs(w1 - w2) END) AS shifted,
  sum(w * fwd) - sum(abs(w - w1) * CASE WHEN w > 0 THEN 5 WHEN w < 0 THEN 20 ELSE 0 END) / 1e4 AS uneven, sum(w * fwd) - sum(2 * abs(w - w1) * 10 / 1e4 + abs(w) * 0.1 / 365) AS borrowed,
  sum(CASE WHEN w > 0 THEN w * fwd ELSE 0 END) AS long_leg, sum(CASE WHEN w < 0 THEN w * fwd ELSE 0 END) AS short_leg FROM lw GROUP BY ts""", "plain lagged shifted uneven borrowed long_leg short_leg", "ts")
def book_variants(spark: SparkSession, sf: str) -> DataFrame:
    """One book under every way of charging it, and its two legs."""
    w = weights(spark, sf)
    made = {
        "plain": books.book(w, "fwd", 5),
        "lagged": books.book(w, "fwd", 5, lag=1),
        "shifted": books.book(w, "ret", 5, lag=1, first_free=True),
        "uneven": books.uneven_book(w, "fwd", 5, 20),
        "borrowed": books.borrowing_book(w, "fwd", 10, 0.1),
    }
    out = books.legs(w, "fwd")
    for name, b in made.items():
        out = out.join(b.select("ts", F.col("net").alias(name)), "ts")
    return out


@query(f"""{WEIGHTS}, b AS (SELECT ts, sum(abs(w - w1)) AS t, sum(abs(w)) AS g, count(*) FILTER (w <> 0) AS k FROM lw GROUP BY ts)
SELECT avg(t) AS per_bar, avg(t) * 52 * 5 / 1e4 AS cost_year, count(*) FILTER (t > 1e-12) AS trade_bars, avg(g) AS gross, avg(k) AS names FROM b""", "per_bar cost_year gross names", "trade_bars")
def turnover_profile(spark: SparkSession, sf: str) -> DataFrame:
    return books.turnover_stats(weights(spark, sf), 5, 52)


# ---- the battery

#: Metrics of rows (name, ppy, split, ts, net, pos), as B.metrics has them.
METRICS = """seq AS (SELECT *, abs(pos - lag(pos, 1, 0) OVER w) AS tn, sum(ln(1 + net)) OVER w AS le, net - avg(net) OVER (PARTITION BY name, ppy, split) AS c FROM nets WINDOW w AS (PARTITION BY name, ppy, split ORDER BY ts)),
tops AS (SELECT *, max(le) OVER (PARTITION BY name, ppy, split ORDER BY ts) AS top FROM seq),
met AS (SELECT name, ppy, split, count(*) AS n, avg(net) / stddev_samp(net) AS sr_pp, avg(net) / stddev_samp(net) * sqrt(ppy) AS sharpe_ann, avg(net) * ppy AS ret_ann, stddev_samp(net) * sqrt(ppy) AS vol_ann, min(exp(le - top) - 1) AS maxdd,
  avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS hit, avg(tn) AS turnover, avg(c * c * c) / avg(c * c) ** 1.5 AS skew, avg(c * c * c * c) / avg(c * c) ** 2 AS kurt FROM tops GROUP BY name, ppy, split HAVING count(*) >= 10 AND stddev_samp(net) > 0)"""

#: Daily prices whose logarithmic moves are a hundredth of the table's, so that returns compound.
GENTLE = f"""{WITH_D}, base AS (SELECT symbol, ts, ln(close) / 100 AS lp, ln(spot) / 100 AS ls, funding, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM daily),
g AS (SELECT symbol, ts, exp(lp) AS px, exp(ls) AS spot, funding, coalesce(exp(lp - lag(lp) OVER w) - 1, 0) AS ret, coalesce(exp(ls - lag(ls) OVER w) - 1, 0) AS sret FROM base WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def gentle(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, ts, px, spot, funding, ret, sret: daily panel whose logarithmic moves are a hundredth of the table's, first returns zero."""
    d = P.daily(spark, sf).select("symbol", "ts", (F.log("close") / 100).alias("lp"), (F.log("spot") / 100).alias("ls"), "funding")
    move = lambda c: F.coalesce(F.exp(F.col(c) - S.lagged(c)) - 1, F.lit(0.0))
    return d.select("symbol", "ts", F.exp("lp").alias("px"), F.exp("ls").alias("spot"), "funding", move("lp").alias("ret"), move("ls").alias("sret"))


BATTERY = f"""{GENTLE},
carry0 AS (SELECT symbol, ts, funding + sret - ret AS unit, coalesce(sign(lag(funding) OVER w), 0) AS pos FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
carry AS (SELECT 'H1_carry/' || symbol AS name, 1095 AS ppy, ts, pos, pos * unit - 2 * abs(pos - lag(pos, 1, 0) OVER (PARTITION BY symbol ORDER BY ts)) * 5 / 1e4 AS net FROM carry0),
nsym AS (SELECT count(DISTINCT symbol) AS k FROM g),
port AS (SELECT 'H1_carry/PORTFOLIO' AS name, 1095 AS ppy, ts, CAST(NULL AS DOUBLE) AS pos, sum(net) / any_value(k) AS net FROM carry, nsym GROUP BY ts),
naive AS (SELECT 'H1_carry_naive/' || symbol AS name, 1095 AS ppy, ts, 1.0 AS pos, unit AS net FROM carry0 WHERE symbol = 'AF'),
mom0 AS (SELECT symbol, ts, ret, h, coalesce(sign(lag(px) OVER w / lag(px, CAST(h AS INTEGER) + 1) OVER w - 1), 0) AS pos, lag(px) OVER w / lag(px, CAST(h AS INTEGER) + 1) OVER w - 1 AS trail FROM g, (SELECT unnest([7, 14, 30]) AS h) WINDOW w AS (PARTITION BY symbol, h ORDER BY ts)),
mom AS (SELECT 'H2_tsmom' || h || '/' || symbol AS name, 365 AS ppy, ts, pos, pos * ret - abs(pos - lag(pos, 1, 0) OVER (PARTITION BY symbol, h ORDER BY ts)) * 5 / 1e4 AS net FROM mom0),
xk AS (SELECT *, count(trail) OVER (PARTITION BY h, ts) AS n, row_number() OVER (PARTITION BY h, ts, trail IS NULL ORDER BY trail, symbol) AS up, row_number() OVER (PARTITION BY h, ts, trail IS NULL ORDER BY trail DESC, symbol) AS dn FROM mom0),
xp AS (SELECT symbol, h, ts, ret, CASE WHEN trail IS NULL OR n < 6 THEN 0 WHEN up <= greatest(1, n // 3) THEN -1.0 / greatest(1, n // 3) WHEN dn <= greatest(1, n // 3) THEN 1.0 / greatest(1, n // 3) ELSE 0 END AS pos FROM xk),
xt AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL THEN 0 ELSE abs(pos - lag(pos) OVER w) END AS tn FROM xp WINDOW w AS (PARTITION BY symbol, h ORDER BY ts)),
xs AS (SELECT 'H3_xsmom' || h AS name, 365 AS ppy, ts, sum(abs(pos)) AS pos, sum(pos * ret) - sum(tn) * 5 / 1e4 AS net FROM xt GROUP BY h, ts),
rev0 AS (SELECT symbol, ts, ret, coalesce(-sign(lag(ret) OVER (PARTITION BY symbol ORDER BY ts)), 0) AS pos FROM g),
rev AS (SELECT 'H4_reversal/' || symbol AS name, 1095 AS ppy, ts, pos, pos * ret - abs(pos - lag(pos, 1, 0) OVER (PARTITION BY symbol ORDER BY ts)) * 5 / 1e4 AS net FROM rev0),
every AS (SELECT * FROM carry UNION ALL SELECT * FROM port UNION ALL SELECT * FROM naive UNION ALL SELECT * FROM mom UNION ALL SELECT * FROM xs UNION ALL SELECT * FROM rev),
nets AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY ts) <= floor(count(*) OVER (PARTITION BY name) * 0.6) THEN 'is' ELSE 'oos' END AS split FROM every), {METRICS}"""


def battery_nets(spark: SparkSession, sf: str) -> DataFrame:
    """name, ppy, ts, pos, net of every variant of the four hypotheses: one union, in which a variant is rows."""
    g = gentle(spark, sf)
    by = S.by_symbol()
    cost = lambda c: F.abs(F.col(c) - F.lag(c, 1, 0.0).over(by)) * 5 / 1e4
    carry = g.select(
        "symbol", "ts", (F.col("funding") + F.col("sret") - F.col("ret")).alias("unit"),
        F.coalesce(F.signum(S.lagged("funding")), F.lit(0.0)).alias("pos")
    )
    carry = carry.withColumn("net", F.col("pos") * F.col("unit") - 2 * cost("pos"))
    row = lambda df, name, ppy: df.select(name.alias("name"), F.lit(ppy).alias("ppy"), "ts", F.col("pos").cast("double").alias("pos"), "net")
    h1 = row(carry, F.concat(F.lit("H1_carry/"), "symbol"), 1095)
    count = g.agg(F.count_distinct("symbol").alias("k"))
    port = carry.groupBy("ts").agg(F.sum("net").alias("s")).join(F.broadcast(count), F.lit(True)).select(
        "ts", F.lit(None).cast("double").alias("pos"), F.expr("s / k").alias("net")
    )
    naive = carry.where("symbol = 'AF'").select("symbol", "ts", F.lit(1.0).alias("pos"), F.col("unit").alias("net"))
    looks = (7, 14, 30)
    looked = g.withColumns({f"t{h}": F.lag("px").over(by) / F.lag("px", h + 1).over(by) - 1 for h in looks})
    trails = [F.struct(F.lit(h).alias("h"), F.col(f"t{h}").alias("trail")) for h in looks]
    mom = looked.select("symbol", "ts", "ret", F.inline(F.array(*trails))).withColumn("pos", F.coalesce(F.signum("trail"), F.lit(0.0)))
    per = W.partitionBy("symbol", "h").orderBy("ts")
    h2 = mom.withColumn("net", F.col("pos") * F.col("ret") - F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(per)) * 5 / 1e4)
    day = W.partitionBy("h", "ts", F.isnull("trail"))
    k = mom.drop("pos").withColumns(
        {
            "n": F.count("trail").over(W.partitionBy("h", "ts")), "up": F.row_number().over(day.orderBy("trail", "symbol")),
            "dn": F.row_number().over(day.orderBy(F.desc("trail"), "symbol"))
        }
    )
    third = "greatest(1, n DIV 3)"
    x = k.withColumn(
        "pos",
        F.expr(
            f"CASE WHEN trail IS NULL OR n < 6 THEN 0.0D WHEN up <= {third} THEN -1.0D / {third} WHEN dn <= {third} THEN 1.0D / {third} ELSE 0.0D END"
        )
    )
    x = x.withColumn("tn", F.coalesce(F.abs(F.col("pos") - F.lag("pos").over(per)), F.lit(0.0)))
    h3 = x.groupBy("h", "ts").agg(F.sum(F.abs("pos")).alias("pos"), (F.sum(F.col("pos") * F.col("ret")) - F.sum("tn") * 5 / 1e4).alias("net"))
    rev = g.select("symbol", "ts", "ret", F.coalesce(-F.signum(S.lagged("ret")), F.lit(0.0)).alias("pos"))
    rev = rev.withColumn("net", F.col("pos") * F.col("ret") - cost("pos"))
    every = h1.unionByName(row(port, F.lit("H1_carry/PORTFOLIO"), 1095)).unionByName(row(naive, F.concat(F.lit("H1_carry_naive/"), "symbol"), 1095))
    every = every.unionByName(
        row(h2, F.concat(F.lit("H2_tsmom"), "h", F.lit("/"), "symbol"), 365)
    ).unionByName(row(h3, F.concat(F.lit("H3_xsmom"), "h"), 365))
    return every.unionByName(row(rev, F.concat(F.lit("H4_reversal/"), "symbol"), 1095))


def evaluated(nets: DataFrame, keys: list[str], per_year, every: bool = False) -> DataFrame:
    """Metrics in and out of sample for rows (keys, ts, pos, net); every: of infinite returns too."""
    return B.metrics(B.split(nets, keys), [*keys, "split"], per_year, "pos", every).where("sr_pp IS NOT NULL")


_PSR = normal_cdf_sql("(sr_pp * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sr_pp + (kurt - 1) / 4 * sr_pp * sr_pp)))")
_DSR = normal_cdf_sql("((sr_pp - star) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sr_pp + (kurt - 1) / 4 * sr_pp * sr_pp)))")


@query(f"""{BATTERY}, stars AS (SELECT ppy, {benchmark_sql("coalesce(stddev_samp(sr_pp), 0)", "count(*)")} AS star, count(*) AS trials FROM met WHERE split = 'oos' GROUP BY ppy),
o AS (SELECT met.*, star, trials FROM met JOIN stars USING (ppy) WHERE split = 'oos')
SELECT name, ppy, n, trials, sharpe_ann, ret_ann, vol_ann, maxdd, hit, turnover, skew, kurt, star AS sr_star_pp, {_PSR} AS psr, {_DSR} AS dsr_prob FROM o""", "sharpe_ann ret_ann vol_ann maxdd hit turnover skew kurt sr_star_pp psr dsr_prob", "name ppy n trials")
def battery_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """All variants out of sample, deflated among those of their own frequency: one job, whose benchmark is a row for each frequency."""
    m = evaluated(battery_nets(spark, sf), ["name", "ppy"], F.col("ppy")).where("split = 'oos'")
    stars = m.groupBy("ppy").agg(F.stddev_samp("sr_pp").alias("v"), F.count("*").alias("trials")).select(
        "ppy", "trials", benchmark(F.coalesce("v", F.lit(0.0)), F.col("trials")).alias("sr_star_pp")
    )
    o = m.join(F.broadcast(stars), "ppy")
    return o.withColumns({"psr": B.psr(), "dsr_prob": B.psr(F.col("sr_star_pp"))})


@query(f"""{BATTERY}, best AS (SELECT split_part(name, '/', 2) AS symbol, arg_max(name, (sr_pp, name)) AS name FROM met WHERE split = 'is' AND name LIKE 'H2%' GROUP BY 1)
SELECT best.symbol, met.name, n, sr_pp, row_number() OVER (ORDER BY sr_pp DESC, met.name) AS place FROM met JOIN best USING (name) WHERE split = 'oos'""", "sr_pp", "symbol name n place")
def top_in_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The variant of each symbol that did best in sample, ordered by what it did after."""
    m = evaluated(battery_nets(spark, sf).where("name LIKE 'H2%'"), ["name", "ppy"], F.col("ppy"))
    best = m.where("split = 'is'").groupBy(
        F.split_part("name", F.lit("/"), F.lit(2)).alias("symbol")
    ).agg(F.max_by("name", F.struct("sr_pp", "name")).alias("name"))
    return m.where("split = 'oos'").join(best, "name").withColumn("place", F.row_number().over(W.orderBy(F.desc("sr_pp"), "name")))


# ---- validation


@query(f"""{BATTERY}, pair AS (SELECT a.name, a.sr_pp AS ins, b.sr_pp AS oos, b.ret_ann FROM met a JOIN met b USING (name) WHERE a.split = 'is' AND b.split = 'oos')
SELECT count(*) AS variants, corr(ins, oos) AS kept, avg(CASE WHEN oos > ins THEN 1.0 ELSE 0 END) AS improving, quantile_cont(oos - ins, 0.5) AS median_change FROM pair""", "kept improving median_change", "variants")
def robustness(spark: SparkSession, sf: str) -> DataFrame:
    """How far ratios in sample tell those after, over all variants."""
    return validation.robustness(evaluated(battery_nets(spark, sf), ["name", "ppy"], F.col("ppy")), ["name", "ppy"])


_LAGGED = f"""{GENTLE}, sig AS (SELECT symbol, ts, ret, sign(px / lag(px, 7) OVER (PARTITION BY symbol ORDER BY ts) - 1) AS s FROM g),
grid AS (SELECT symbol, ts, ret, k, bps, coalesce(lag(s, CAST(k AS INTEGER)) OVER (PARTITION BY symbol, k, bps ORDER BY ts), 0) AS pos FROM sig, (SELECT unnest([1, 2, 3]) AS k), (SELECT unnest([0.0, 1.8, 4.5]) AS bps)),
every AS (SELECT symbol || '/' || k || '/' || bps AS name, 365 AS ppy, ts, pos, pos * ret - abs(pos - lag(pos, 1, 0) OVER (PARTITION BY symbol, k, bps ORDER BY ts)) * bps / 1e4 AS net, k, bps, symbol FROM grid),
nets AS (SELECT name, ppy, ts, pos, net, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY ts) <= floor(count(*) OVER (PARTITION BY name) * 0.6) THEN 'is' ELSE 'oos' END AS split FROM every), {METRICS},
keyed AS (SELECT DISTINCT name, symbol, k, bps FROM every)"""


def _lag_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Momentum under every lag and fee: symbol, k, bps with metrics out of sample."""
    sig = gentle(spark, sf).withColumn("s", F.signum(F.col("px") / F.lag("px", 7).over(S.by_symbol()) - 1))
    sig = sig.withColumns({f"p{k}": F.coalesce(S.lagged("s", k), F.lit(0.0)) for k in (1, 2, 3)})
    lags = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("pos")) for k in (1, 2, 3)])
    fees = F.explode(F.array(*[F.lit(x) for x in (0.0, 1.8, 4.5)]))
    grid = sig.select("symbol", "ts", "ret", F.inline(lags)).withColumn("bps", fees)
    turn = F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(W.partitionBy("symbol", "k", "bps").orderBy("ts")))
    return evaluated(grid.withColumn("net", F.col("pos") * F.col("ret") - turn * F.col("bps") / 1e4), ["symbol", "k", "bps"], 365)


@query(f"""{_LAGGED}
SELECT symbol, k, bps, n, sr_pp, ret_ann FROM met JOIN keyed USING (name) WHERE split = 'oos'""", "bps sr_pp ret_ann", "symbol k n")
def lag_and_fee_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The same signal later, and under other fees: a leak shows as a ratio that later signals lack."""
    return _lag_grid(spark, sf).where("split = 'oos'")


@query(f"""{_LAGGED}, w AS (SELECT symbol, max(CASE WHEN k = 1 AND bps = 0 THEN sr_pp END) AS base, max(CASE WHEN k = 2 AND bps = 0 THEN sr_pp END) AS later, max(CASE WHEN k = 1 AND bps > 4 THEN sr_pp END) AS taker, avg(sr_pp) AS mean, avg(CASE WHEN sr_pp > 0 THEN 1.0 ELSE 0 END) AS share FROM met JOIN keyed USING (name) WHERE split = 'oos' GROUP BY symbol)
SELECT symbol, base, later, taker, mean, share, later < base - 0.1 AND base > 0.1 AS leak, taker > 0 AS survives FROM w""", "base later taker mean share", "symbol leak survives")
def fragility(spark: SparkSession, sf: str) -> DataFrame:
    """Over the grid of lags and fees: is the base result a lone peak, and does it survive its fee?"""
    o = _lag_grid(spark, sf).where("split = 'oos'")
    at = lambda e: F.max(F.when(F.expr(e), F.col("sr_pp")))
    w = o.groupBy("symbol").agg(
        at("k = 1 AND bps = 0").alias("base"), at("k = 2 AND bps = 0").alias("later"), at("k = 1 AND bps > 4").alias("taker"),
        F.avg("sr_pp").alias("mean"), F.avg(F.expr("CASE WHEN sr_pp > 0 THEN 1.0D ELSE 0.0D END")).alias("share")
    )
    return w.withColumns({"leak": F.expr("later < base - 0.1 AND base > 0.1"), "survives": F.expr("taker > 0")})


_GATED = f"""{GENTLE}, v AS (SELECT symbol, ts, ret, stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS vol, avg(abs(ret)) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) AS act, row_number() OVER (PARTITION BY symbol ORDER BY ts) <= floor(count(*) OVER (PARTITION BY symbol) * 0.6) AS ins FROM g),
cuts AS (SELECT symbol, quantile_cont(vol, 0.7) AS cv, quantile_cont(act, 0.7) AS ca FROM v WHERE ins GROUP BY symbol),
gates AS (SELECT symbol, ts, ret, lag(CASE WHEN vol > cv THEN 0.0 ELSE 1 END, 1, 1) OVER w AS by_vol, lag(CASE WHEN act > ca THEN 0.0 ELSE 1 END, 1, 1) OVER w AS by_act FROM v JOIN cuts USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
rows_ AS (SELECT symbol, ts, ret, unnest(['base', 'overlay', 'trivial']) AS arm, unnest([1.0, by_act, by_vol]) AS pos FROM gates),
every AS (SELECT symbol || '/' || arm AS name, 365 AS ppy, ts, pos, pos * ret - abs(pos - lag(pos, 1, 0) OVER (PARTITION BY symbol, arm ORDER BY ts)) * 5 / 1e4 AS net FROM rows_),
nets AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY ts) <= floor(count(*) OVER (PARTITION BY name) * 0.6) THEN 'is' ELSE 'oos' END AS split FROM every), {METRICS}"""


@query(f"""{_GATED}, w AS (SELECT split_part(name, '/', 1) AS symbol, {", ".join(f"max(CASE WHEN name LIKE '%/{a}' THEN {c} END) AS {a}_{c}" for a in ("base", "overlay", "trivial") for c in ("sharpe_ann", "maxdd"))} FROM met WHERE split = 'oos' GROUP BY 1)
SELECT symbol, overlay_sharpe_ann - base_sharpe_ann AS gain, overlay_maxdd - base_maxdd AS shallower, overlay_sharpe_ann - base_sharpe_ann > 0.1 AND overlay_maxdd >= base_maxdd AS improves, overlay_sharpe_ann > trivial_sharpe_ann AS beats_trivial FROM w""", "gain shallower", "symbol improves beats_trivial")
def overlay_test(spark: SparkSession, sf: str) -> DataFrame:
    """A gate on activity against no gate and against the plain gate on volatility; thresholds come from the first part alone and act a day later."""
    g = gentle(spark, sf).select(
        "symbol", "ts", "ret", F.stddev_samp("ret").over(S.trailing(10)).alias("vol"), F.avg(F.abs("ret")).over(S.trailing(5)).alias("act")
    )
    gates = validation.gates(B.split(g, ["symbol"]), ["vol", "act"], 0.7)
    arms = F.array(
        *[
            F.struct(F.lit(a).alias("arm"), c.alias("pos")) for a,
            c in (("base", F.lit(1.0)), ("overlay", F.col("by_act")), ("trivial", F.col("by_vol")))
        ]
    )
    rows = gates.select("symbol", "ts", "ret", F.inline(arms))
    turn = F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(W.partitionBy("symbol", "arm").orderBy("ts")))
    m = evaluated(rows.withColumn("net", F.col("pos") * F.col("ret") - turn * 5 / 1e4), ["symbol", "arm"], 365).where("split = 'oos'")
    return validation.overlay_verdict(m, ["symbol"], "arm", "base", "overlay", "trivial", 0.1)


@query(f"""{BATTERY}, stars AS (SELECT ppy, {benchmark_sql("coalesce(stddev_samp(sr_pp), 0)", "count(*)")} AS star FROM met WHERE split = 'oos' GROUP BY ppy), o AS (SELECT met.*, star, {_PSR} AS psr, {_DSR} AS dsr FROM met JOIN stars USING (ppy) WHERE split = 'oos')
SELECT name, CASE WHEN psr >= 0.95 AND dsr >= 0.95 AND ret_ann > 0 AND sharpe_ann > 0 THEN 'EDGE' WHEN psr >= 0.8 AND ret_ann > 0 AND sharpe_ann > 0 THEN 'MARGINAL' ELSE 'DEAD' END AS by_probability,
  CASE WHEN psr >= 0.95 AND sr_pp > star AND ret_ann > 0 THEN 'EDGE' WHEN psr >= 0.8 AND ret_ann > 0 THEN 'MARGINAL' ELSE 'DEAD' END AS by_benchmark, CASE WHEN psr >= 0.8 THEN 'MARGINAL' ELSE 'DEAD' END AS capped, ret_ann > 0 AND sharpe_ann > 1 AND psr >= 0.95 AND dsr >= 0.95 AS survives FROM o""", "", "name by_probability by_benchmark capped survives")
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule that turns metrics into a verdict, on the whole battery."""
    board = battery_leaderboard(spark, sf)
    return validation.verdicts(board)


@query(f"""{BATTERY}, o AS (SELECT *, 1 - skew * sr_pp + (kurt - 1) / 4 * sr_pp * sr_pp AS q FROM met)
SELECT name, split, n, CASE WHEN n > 2 AND q > 0 THEN {normal_cdf_sql("(sr_pp * sqrt(n - 1) / sqrt(CASE WHEN q > 0 THEN q ELSE 1 END))")} END AS psr_strict FROM o""", "psr_strict", "name split n")
def strict_probability(spark: SparkSession, sf: str) -> DataFrame:
    """The probabilistic ratio without a floor below its spread: none where that is not positive."""
    return evaluated(battery_nets(spark, sf), ["name", "ppy"], F.col("ppy")).withColumn("psr_strict", B.psr_strict())
