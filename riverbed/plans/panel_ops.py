"""Preparation, alignment and aggregation queries over panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions import names as N
from riverbed.functions import series as S
from riverbed.operators import joins as J
from riverbed.plans.registry import query
from riverbed.plans.research import DRETS, RETS, WITH_D, WITH_T, WITH_W, _daily_returns, _weekly_returns
from riverbed.sources import panels as P

WITH_B, WITH_C = f"WITH {P.BARS}", f"WITH {P.CONTRACTS}"


# ---- preparation


@query(f"""{WITH_W}, c AS (SELECT symbol, count(close) AS n FROM weekly GROUP BY symbol), t AS (SELECT count(DISTINCT ts) AS t FROM weekly)
SELECT symbol, ts, close FROM weekly WHERE symbol IN (SELECT symbol FROM c, t WHERE n >= 0.9 * t AND n >= 100)""", "close", "symbol ts")
def coverage_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols with a value on nine dates of ten, and a hundred at least."""
    d = P.weekly_universe(spark, sf).select("symbol", "ts", "close")
    dates = d.agg(F.count_distinct("ts").alias("t"))
    kept = d.groupBy("symbol").agg(F.count("close").alias("n")).join(F.broadcast(dates), F.expr("n >= 0.9D * t AND n >= 100"), "left_semi")
    return d.join(kept, "symbol", "left_semi")


@query(f"""{WITH_T}, g AS (SELECT symbol, time_bucket(INTERVAL '8 hours', ts) AS bar, ts, seq, price, TRY_CAST(CAST(price AS VARCHAR) || CASE WHEN seq % 7 = 0 THEN 'x' ELSE '' END AS DOUBLE) AS px FROM ticks)
SELECT symbol, bar AS ts, arg_max(price, (g.ts, seq)) AS last_px, arg_min(price, (g.ts, seq)) AS first_px, count(px) AS numbers, count(*) - 1 AS dropped FROM g GROUP BY symbol, bar""", "last_px first_px", "symbol ts numbers dropped")
def standard_index(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks snapped to an eight-hour grid and made distinct, keeping the last and the first; what is no number becomes null."""
    text = F.concat(F.col("price").cast("string"), F.when(F.col("seq") % 7 == 0, "x").otherwise(""))
    g = P.ticks(spark, sf).withColumns({"bar": F.window("ts", "8 hours").start, "px": text.try_cast("double")})
    order = F.struct("ts", "seq")
    out = g.groupBy("symbol", "bar").agg(
        F.max_by("price", order).alias("last_px"), F.min_by("price", order).alias("first_px"), F.count("px").alias("numbers"),
        (F.count("*") - 1).alias("dropped")
    )
    return out.withColumnRenamed("bar", "ts")


@query("""WITH n AS (SELECT p_partkey, upper(regexp_replace(p_name, '[/_ -]', '', 'g')) AS s, p_brand FROM part), m AS (SELECT *, CASE WHEN ends_with(s, 'USDT') THEN s ELSE s || 'USDT' END AS symbol FROM n)
SELECT p_partkey, symbol, regexp_replace(symbol, 'USDT$', '') AS coin, regexp_matches(symbol, 'RING|BOLT|GEAR') AS tokenised, split_part(p_brand, '#', 2) AS code, starts_with(p_brand, 'Brand#') AS branded, substring(md5(symbol || '|8h'), 1, 16) AS tag FROM m""", "", "p_partkey symbol coin tokenised code branded tag")
def symbol_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names brought to one form, their parts, a flag for classes of them, and the key of a cached file."""
    symbol = N.normalized(F.col("p_name"))
    p = P.table(spark, sf, "part").withColumn("symbol", symbol)
    return p.select(
        "p_partkey", "symbol", N.coin(F.col("symbol")).alias("coin"), N.flagged(F.col("symbol"), ("RING", "BOLT", "GEAR")).alias("tokenised"),
        F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("code"), F.startswith("p_brand", F.lit("Brand#")).alias("branded"),
        N.tag(F.col("symbol"), F.lit("8h")).alias("tag")
    )


@query(f"""{WITH_C}
SELECT symbol, code, expiry, CAST(epoch_ms(CAST(expiry AS TIMESTAMP)) AS BIGINT) AS expiry_ms, count(*) AS days, min(dte) AS least_dte, CAST(floor(min(epoch(expiry + INTERVAL 8 HOUR) - epoch(CAST(ts AS TIMESTAMP))) / 86400.0) AS BIGINT) AS whole_days, min(epoch(expiry + INTERVAL 8 HOUR) - epoch(CAST(ts AS TIMESTAMP))) / 86400.0 AS part_days FROM contracts GROUP BY symbol, code, expiry""", "part_days", "symbol code expiry_ms days least_dte whole_days")
def expiry_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Contract codes read back to dates and milliseconds; days to expiry whole and in fractions."""
    c = P.contracts(spark, sf).withColumn("expiry", N.expiry(F.col("code")))
    left = F.unix_timestamp(F.col("expiry").cast("timestamp")) + 8 * 3600 - F.unix_timestamp(F.col("ts").cast("timestamp"))
    out = c.groupBy("symbol", "code", "expiry").agg(
        F.count("*").alias("days"), F.min("dte").alias("least_dte"), (F.min(left) / 86400.0).alias("part_days")
    )
    return out.withColumns({"expiry_ms": F.unix_millis(F.col("expiry").cast("timestamp")), "whole_days": F.floor("part_days")})


@query(f"""{WITH_B}, grid AS (SELECT symbol, ts FROM (SELECT DISTINCT ts FROM bars), (SELECT DISTINCT symbol FROM bars)),
f AS (SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS close, coalesce(volume, 0) AS volume FROM grid LEFT JOIN bars USING (symbol, ts)),
x AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM f)
SELECT symbol, count(*) AS bars, count(*) FILTER (d = 0 AND volume = 0) AS frozen, count(*) FILTER (volume = 0) AS silent FROM x GROUP BY symbol""", "", "symbol bars frozen silent")
def frozen_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of a dense grid without change and without volume."""
    b = P.bars(spark, sf).select("symbol", "ts", "close", "volume")
    f = P.dense(b.select("symbol", "ts", "close"), ["close"]).join(b.drop("close"), ["symbol", "ts"], "left").fillna(0.0, ["volume"])
    x = f.withColumn("d", F.col("close") - S.lagged("close"))
    return x.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count_if(F.expr("d = 0 AND volume = 0")).alias("frozen"), F.count_if(F.expr("volume = 0")).alias("silent")
    )


@query(f"""{WITH_D}
SELECT symbol, ts, funding * 1095 AS per_8h, funding * 3 * 365 * 100 AS percent, funding * 24.0 / CASE WHEN symbol LIKE '%O' THEN 4 ELSE 8 END * 365 AS by_interval FROM daily""", "per_8h:8 percent by_interval:8", "symbol ts")
def annual_funding(spark: SparkSession, sf: str) -> DataFrame:
    """Funding a year: of three payments a day, in per cent, and by each venue's own interval."""
    hours = F.when(F.col("symbol").endswith("O"), 4).otherwise(8)
    f = F.col("funding")
    return P.daily(spark, sf).select(
        "symbol", "ts", (f * 1095).alias("per_8h"), (f * 3 * 365 * 100).alias("percent"), (f * 24.0 / hours * 365).alias("by_interval")
    )


FEATURES = ("ret", "ret5", "hl", "co", "vol", "ofi", "vwapdev", "fund", "rng")
FEATURES_SQL = f"""{WITH_B}, raw AS (SELECT symbol, ts, close, close / lag(close) OVER w - 1 AS ret, close / lag(close, 5) OVER w - 1 AS ret5, (high - low) / close AS hl, (close - open) / open AS co, ln(volume + 1) AS vol,
  (2 * taker - volume) / (volume + 1e-9) AS ofi, close / (qvol / (volume + 1e-9)) - 1 AS vwapdev, funding AS fund, (high - low) / (abs(close - open) + 1e-9) AS rng, lead(close) OVER w / close - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
feats AS (SELECT symbol, ts, close, fwd, ret AS raw_ret, {", ".join(f"greatest(-4, least(4, ({c} - avg({c}) OVER t) / (stddev_pop({c}) OVER t + 1e-9))) AS {c}" for c in FEATURES)} FROM raw WINDOW t AS (PARTITION BY ts))"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, ts, close, fwd, raw_ret and the nine features, standardised over the symbols of a day."""
    b = P.bars(spark, sf)
    raw = b.select(
        "symbol", "ts", "close", S.simple_return("close").alias("ret"), S.simple_return("close", 5).alias("ret5"), F.expr("(high - low) / close").alias("hl"), F.expr("(close - open) / open").alias("co"),
        F.expr("ln(volume + 1)").alias("vol"), F.expr("(2 * taker - volume) / (volume + 1e-9D)").alias("ofi"), F.expr("close / (qvol / (volume + 1e-9D)) - 1").alias("vwapdev"), F.col("funding").alias("fund"),
        F.expr("(high - low) / (abs(close - open) + 1e-9D)").alias("rng"), S.forward_return("close").alias("fwd"),
    )
    return raw.select("symbol", "ts", "close", "fwd", F.col("ret").alias("raw_ret"), *[S.row_zscore(c).alias(c) for c in FEATURES])


@query(f"""{FEATURES_SQL}
SELECT symbol, ts, {", ".join(FEATURES)} FROM feats""", " ".join(f"{c}:4" for c in FEATURES), "symbol ts")
def ohlcv_features(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf)


@query(f"""{FEATURES_SQL}
SELECT ts, count(ret) AS breadth, count(fwd) AS targets FROM feats GROUP BY ts""", "", "ts breadth targets")
def panel_breadth(spark: SparkSession, sf: str) -> DataFrame:
    """How many symbols of the ragged panel have a value on each day."""
    return features(spark, sf).groupBy("ts").agg(F.count("ret").alias("breadth"), F.count("fwd").alias("targets"))


# ---- joins


@query(f"""{DRETS}, a AS (SELECT ts, ret FROM r WHERE symbol = 'AF' AND ret IS NOT NULL), b AS (SELECT ts, ret FROM r WHERE symbol = 'NO' AND ret IS NOT NULL)
SELECT ts, a.ret AS x, b.ret AS y FROM a JOIN b USING (ts)""", "x y", "ts")
def inner_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams side by side where both have a value."""
    r = _daily_returns(spark, sf).where("ret IS NOT NULL")
    return r.where("symbol = 'AF'").select("ts", F.col("ret").alias("x")).join(r.where("symbol = 'NO'").select("ts", F.col("ret").alias("y")), "ts")


@query(f"""{DRETS}, a AS (SELECT ts, ret AS x FROM r WHERE symbol = 'AF'), b AS (SELECT ts, ret AS y FROM r WHERE symbol = 'NO'), c AS (SELECT ts, ret AS z FROM r WHERE symbol = 'RO')
SELECT ts, coalesce(x, 0) + coalesce(y, 0) + coalesce(z, 0) AS total FROM a FULL JOIN b USING (ts) FULL JOIN c USING (ts)""", "total", "ts")
def outer_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Three streams on the union of their days, zero where one has none."""
    r = _daily_returns(spark, sf)
    return J.outer_zero([r.where(F.col("symbol") == s) for s in ("AF", "NO", "RO")], "ts", "ret")


@query(f"""{WITH_D}, o AS (SELECT o_orderstatus AS side, CAST(o_orderdate AS DATE) AS ts, count(*) AS oi, sum(o_totalprice) AS oi_value FROM orders GROUP BY 1, 2), d AS (SELECT symbol, substring(symbol, 2, 1) AS side, ts FROM daily)
SELECT symbol, d.ts, oi, oi_value FROM d ASOF LEFT JOIN o ON d.side = o.side AND d.ts >= o.ts""", "oi_value:2", "symbol ts oi")
def asof_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """The last known open interest of a symbol's own side at each of its bars."""
    bars = P.daily(spark, sf).select("symbol", F.substring("symbol", 2, 1).alias("side"), "ts")
    counts = P.table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("side"), F.to_date("o_orderdate").alias("ts")
    ).agg(F.count("*").alias("oi"), F.sum("o_totalprice").alias("oi_value"))
    return J.asof(bars, counts, ["side"], ["oi", "oi_value"])


@query(
    """SELECT n_name, r_name, count(*) AS orders, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "value:2", "n_name r_name orders"
)
def lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Orders counted by their customers' nation: aggregated before the names are looked up."""
    c = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    by_customer = P.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    by_nation = by_customer.join(c, "o_custkey").groupBy("n_nationkey").agg(F.sum("n").alias("orders"), F.sum("v").alias("value"))
    named = J.lookup(by_nation, P.table(spark, sf, "nation"), "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return J.lookup(named, P.table(spark, sf, "region"), "r_regionkey")


PAIRS = f"""{WITH_C}, k AS (SELECT DISTINCT symbol, code, expiry FROM contracts), nx AS (SELECT symbol, code, lead(code) OVER (PARTITION BY symbol ORDER BY expiry) AS far FROM k),
p AS (SELECT a.symbol, a.code AS near, b.code AS far, a.ts, a.dte, b.fut / a.fut - 1 AS spread FROM nx JOIN contracts a ON a.symbol = nx.symbol AND a.code = nx.code JOIN contracts b ON b.symbol = nx.symbol AND b.code = nx.far AND b.ts = a.ts),
spreads AS (SELECT symbol, near, far, count(*) AS n, arg_min(spread, ts) AS entry, arg_max(spread, ts) AS leave, avg(spread) AS mean, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 20)"""


def consecutive_spreads(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, near, far, n, entry, leave, mean of each contract and the next to expire, over the days on which both trade."""
    c = P.contracts(spark, sf)
    pairs = c.select("symbol", "code", "expiry").distinct().select(
        "symbol", F.col("code").alias("near"), F.lead("code").over(W.partitionBy("symbol").orderBy("expiry")).alias("far")
    )
    near = c.select("symbol", "ts", F.col("code").alias("near"), F.col("fut").alias("a")).join(pairs, ["symbol", "near"])
    both = near.join(
        c.select("symbol", "ts", F.col("code").alias("far"), F.col("fut").alias("b")), ["symbol", "ts", "far"]
    ).withColumn("spread", F.expr("b / a - 1"))
    out = both.groupBy("symbol", "near", "far").agg(
        F.count("*").alias("n"), F.min_by("spread", "ts").alias("entry"), F.max_by("spread", "ts").alias("leave"), F.avg("spread").alias("mean")
    )
    return out.where("n >= 20")


@query(f"""{PAIRS}
SELECT symbol, near, far, n, entry, leave, mean, entry - leave - 4 * 7 / 1e4 AS net, (entry - leave - 4 * 7 / 1e4) > 0 AS win FROM spreads""", "entry leave mean net", "symbol near far n win")
def calendar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Sell the far contract against the near one, both legs in and out at seven basis points."""
    return consecutive_spreads(spark, sf).withColumn("net", F.expr("entry - leave - 4 * 7 / 1e4D")).withColumn("win", F.col("net") > 0)


@query(f"""{PAIRS}
SELECT symbol, count(*) AS pairs, avg(CASE WHEN entry - leave - 28 / 1e4 > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(entry - leave - 28 / 1e4) AS mean_net FROM spreads GROUP BY symbol""", "win_rate mean_net", "symbol pairs")
def calendar_summary(spark: SparkSession, sf: str) -> DataFrame:
    net = F.expr("entry - leave - 28 / 1e4D")
    return consecutive_spreads(spark, sf).groupBy("symbol").agg(
        F.count("*").alias("pairs"), F.avg((net > 0).cast("double")).alias("win_rate"), F.avg(net).alias("mean_net")
    )


@query(f"""{WITH_D}, v AS (SELECT substring(symbol, 1, 1) AS coin, substring(symbol, 2, 1) AS venue, ts, sum(funding) AS f FROM daily GROUP BY 1, 2, 3)
SELECT a.coin, a.ts, a.f - b.f AS diff FROM v a JOIN v b ON a.coin = b.coin AND a.ts = b.ts AND a.venue = 'F' AND b.venue = 'O'""", "diff:9", "coin ts")
def venue_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Funding of one venue less that of the other, summed by day, where both paid."""
    v = P.daily(spark, sf).groupBy(F.substring("symbol", 1, 1).alias("coin"), "ts").agg(
        *[F.sum(F.when(F.col("symbol").endswith(x), F.col("funding"))).alias(x) for x in "FO"]
    )
    return v.where("F IS NOT NULL AND O IS NOT NULL").withColumn("diff", F.expr("F - O"))


#: Days on which a coin's first qualifying contract is held, with the spread earned and its costs; funding elsewhere.
HELD_SQL = f"""{WITH_C}, q AS (SELECT *, (fut / spot - 1) * 365 / greatest(dte, 1) AS ann FROM contracts WHERE dte BETWEEN 5 AND 85),
e AS (SELECT symbol, code, arg_min(ann, ts) AS entry FROM q GROUP BY symbol, code),
t AS (SELECT symbol, code, ts, spot / lag(spot) OVER w - fut / lag(fut) OVER w AS unit, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol, code) AS n FROM q JOIN e USING (symbol, code) WHERE entry > 0.02 WINDOW w AS (PARTITION BY symbol, code ORDER BY ts)),
f AS (SELECT symbol, ts, code, coalesce(unit, 0) - CASE WHEN rn = 1 OR rn = n THEN 0.0015 ELSE 0 END AS spread FROM t QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY code) = 1),
held AS (SELECT d.symbol, d.ts, f.code, CASE WHEN f.code IS NOT NULL THEN spread ELSE coalesce(funding, 0) END AS stream FROM daily d LEFT JOIN f USING (symbol, ts))"""


def basis_or_funding(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, ts, code, stream: the first qualifying contract's spread where one is held, else funding."""
    by = W.partitionBy("symbol", "code")
    q = P.contracts(spark, sf).where("dte BETWEEN 5 AND 85").withColumn("ann", F.expr("(fut / spot - 1) * 365 / greatest(dte, 1)"))
    q = q.withColumns(
        {"entry": F.min_by("ann", "ts").over(by), "n": F.count("*").over(by), "rn": F.row_number().over(by.orderBy("ts"))}
    ).where("entry > 0.02")
    prior = lambda c: F.lag(c).over(by.orderBy("ts"))
    unit = F.coalesce(F.col("spot") / prior("spot") - F.col("fut") / prior("fut"), F.lit(0.0))
    held = q.withColumn("spread", unit - F.expr("CASE WHEN rn = 1 OR rn = n THEN 0.0015D ELSE 0.0D END"))
    first = held.groupBy("symbol", "ts").agg(F.min_by(F.struct("code", "spread"), "code").alias("f"))
    d = P.daily(spark, sf).select("symbol", "ts", "funding").join(first, ["symbol", "ts"], "left")
    return d.select("symbol", "ts", F.col("f.code").alias("code"), F.coalesce("f.spread", "funding", F.lit(0.0)).alias("stream"))


@query(f"""{HELD_SQL}
SELECT symbol, ts, code, stream FROM held""", "stream:8", "symbol ts code")
def contract_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return basis_or_funding(spark, sf)


@query(
    """SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""", "",
    "c_custkey c_mktsegment"
)
def anti_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of one set that the other lacks."""
    orders = P.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return P.table(spark, sf, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query(f"""{DRETS}, s AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT symbol, min(ts) AS a, max(ts) AS b FROM r WHERE ret IS NOT NULL GROUP BY symbol))
SELECT ts, count(*) AS n, avg(ret) AS mean FROM r, s WHERE ret IS NOT NULL AND ts BETWEEN a AND b GROUP BY ts""", "mean", "ts n")
def common_window(spark: SparkSession, sf: str) -> DataFrame:
    """Streams from the day on which the last of them begins."""
    live = J.common_window(_daily_returns(spark, sf).where("ret IS NOT NULL"), "symbol")
    return live.groupBy("ts").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"))


@query(f"""{WITH_D}, a AS (SELECT ts FROM daily WHERE symbol = 'AF'), b AS (SELECT ts FROM daily WHERE symbol = 'NO')
SELECT 'all' AS op, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'distinct', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""", "", "op n")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Union, distinct union, intersection and difference of two sets of days, from one aggregate."""
    d = P.daily(spark, sf)
    side = lambda s: F.count_if(F.col("symbol") == s).alias(s)
    c = d.where("symbol IN ('AF', 'NO')").groupBy("ts").agg(side("AF"), side("NO"))
    n = c.agg(
        F.sum(F.expr("AF + NO")).alias("all"), F.count("*").alias("distinct"), F.count_if(F.expr("AF > 0 AND NO > 0")).alias("intersect"),
        F.count_if(F.expr("AF > 0 AND NO = 0")).alias("except")
    )
    return n.select(F.expr("stack(4, 'all', coalesce(`all`, 0), 'distinct', `distinct`, 'intersect', `intersect`, 'except', `except`) AS (op, n)"))


# ---- aggregates


@query(f"""{WITH_C}
SELECT ts, count(*) AS contracts, avg((fut / spot - 1) * 365 / greatest(dte, 1)) AS ann FROM contracts WHERE dte BETWEEN 5 AND 85 GROUP BY ts""", "ann", "ts contracts")
def pooled_basis(spark: SparkSession, sf: str) -> DataFrame:
    return P.contracts(spark, sf).where("dte BETWEEN 5 AND 85").groupBy("ts").agg(
        F.count("*").alias("contracts"), F.avg(F.expr("(fut / spot - 1) * 365 / greatest(dte, 1)")).alias("ann")
    )


@query(f"""{DRETS}, n AS (SELECT count(DISTINCT symbol) AS n FROM daily)
SELECT ts, sum(coalesce(ret, 0)) / any_value(n) AS over_all, avg(ret) AS over_known, sum(coalesce(ret, 0)) / nullif(count(*) FILTER (ret <> 0), 0) AS over_active FROM r, n GROUP BY ts""", "over_all over_known over_active", "ts")
def portfolio_means(spark: SparkSession, sf: str) -> DataFrame:
    """Equal weights over all symbols, over those with a value, and over those that moved."""
    d = _daily_returns(spark, sf)
    n = d.agg(F.count_distinct("symbol").alias("n"))
    sums = d.groupBy("ts").agg(
        F.sum(F.coalesce("ret", F.lit(0.0))).alias("s"), F.avg("ret").alias("over_known"), F.count_if(F.expr("ret <> 0")).alias("k")
    )
    return sums.join(F.broadcast(n), F.lit(True)).select(
        "ts", F.expr("s / n").alias("over_all"), "over_known", F.expr("s / nullif(k, 0)").alias("over_active")
    )


@query(f"""{DRETS}
SELECT symbol, year(ts) AS y, count(ret) AS n, exp(sum(ln(1 + ret))) - 1 AS compounded, exp(sum(ln(1 + 3 * ret / 100))) AS multiple FROM r WHERE ret > -1 GROUP BY 1, 2""", "compounded multiple", "symbol y n")
def compounded(spark: SparkSession, sf: str) -> DataFrame:
    """Compounded return of each year, and what three parts in a hundred of it make of one."""
    r = _daily_returns(spark, sf).where("ret > -1")
    return r.groupBy("symbol", F.year("ts").alias("y")).agg(
        F.count("ret").alias("n"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("compounded"),
        F.exp(F.sum(F.log1p(3 * F.col("ret") / 100))).alias("multiple")
    )


@query(f"""{DRETS}, x AS (SELECT ts, symbol, ret FROM r WHERE ret IS NOT NULL), m AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS rho, count(*) AS n FROM x a JOIN x b USING (ts) GROUP BY 1, 2)
SELECT a, b, n, rho, (SELECT avg(rho) FROM m WHERE a <> b) AS mean_off FROM m""", "rho mean_off", "a b n")
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The whole matrix, and the mean beside its diagonal. Pairs of symbols are the feature; each day's symbols are joined, aggregated on the map side."""
    x = _daily_returns(spark, sf).where("ret IS NOT NULL").select("ts", "symbol", "ret")
    m = x.withColumnsRenamed({"symbol": "a", "ret": "p"}).join(
        x.withColumnsRenamed({"symbol": "b", "ret": "q"}), "ts"
    ).groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("p", "q").alias("rho"))
    return m.join(F.broadcast(m.where("a <> b").agg(F.avg("rho").alias("mean_off"))), F.lit(True))


HOURS = f"""{WITH_T}, hb AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_max(price, (ts, seq)) AS close FROM ticks GROUP BY 1, 2),
hr AS (SELECT symbol, ts, hour(ts) AS h, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM hb)"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, ts, h, ret: logarithmic returns of hourly closes."""
    hb = P.ticks(spark, sf).groupBy("symbol", F.date_trunc("hour", "ts").alias("bar")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("close")
    ).withColumnRenamed("bar", "ts")
    return hb.select("symbol", "ts", F.hour("ts").alias("h"), F.log(F.col("close") / S.lagged("close")).alias("ret"))


@query(f"""{HOURS}
SELECT h, count(ret) AS n, avg(ret) AS mean, avg(ret) / stddev_samp(ret) AS sr FROM hr GROUP BY h HAVING count(ret) > 30""", "mean sr", "h n")
def hour_table(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and ratio of each hour of the day that has over thirty returns."""
    t = hourly(spark, sf).groupBy("h").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"))
    return t.where("n > 30")


@query(f"""{DRETS}, b AS (SELECT symbol, CASE WHEN ret < -0.5 THEN 0 WHEN ret >= 0.5 THEN 11 ELSE CAST(floor((ret + 0.5) / 0.1) AS BIGINT) + 1 END AS bin FROM r WHERE ret IS NOT NULL)
SELECT symbol, bin, count(*) AS n FROM b GROUP BY 1, 2""", "", "symbol bin n")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Counts in ten bins of a tenth around zero, and beyond them."""
    bin_ = F.expr("CASE WHEN ret < -0.5 THEN 0L WHEN ret >= 0.5 THEN 11L ELSE CAST(floor((ret + 0.5D) / 0.1D) AS bigint) + 1 END")
    return _daily_returns(spark, sf).where("ret IS NOT NULL").groupBy("symbol", bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(f"""{DRETS}, k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS lo, row_number() OVER (PARTITION BY symbol ORDER BY ret DESC) AS hi FROM r WHERE ret IS NOT NULL)
SELECT symbol, min(ret) AS worst, sum(CASE WHEN lo <= 5 THEN ret END) AS worst5, sum(CASE WHEN hi <= 5 THEN ret END) AS best5 FROM k GROUP BY symbol""", "worst worst5 best5", "symbol")
def extremes(spark: SparkSession, sf: str) -> DataFrame:
    """The worst bar, and the sums of the five worst and best."""
    by = W.partitionBy("symbol")
    k = _daily_returns(spark, sf).where("ret IS NOT NULL").select(
        "symbol", "ret", F.row_number().over(by.orderBy("ret")).alias("lo"), F.row_number().over(by.orderBy(F.desc("ret"))).alias("hi")
    )
    return k.groupBy("symbol").agg(
        F.min("ret").alias("worst"), F.sum(F.when(F.col("lo") <= 5, F.col("ret"))).alias("worst5"),
        F.sum(F.when(F.col("hi") <= 5, F.col("ret"))).alias("best5")
    )


@query(f"""{WITH_T}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n, min(ts) AS a, max(ts) AS b FROM ticks GROUP BY 1, 2)
SELECT symbol, count(*) AS days, count(*) FILTER (n < 2) AS sparse, count(*) FILTER (n = 3) AS threes, count(*) FILTER (n > 3) AS dense, CAST(date_diff('day', min(CAST(a AS DATE)), max(CAST(b AS DATE))) AS INTEGER) AS span FROM d GROUP BY symbol""", "", "symbol days sparse threes dense span")
def coverage_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Days by how many events they have, and the span of each series."""
    d = P.ticks(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    n = lambda e: F.count_if(F.expr(e))
    return d.groupBy("symbol").agg(
        F.count("*").alias("days"), n("n < 2").alias("sparse"), n("n = 3").alias("threes"), n("n > 3").alias("dense"),
        F.datediff(F.max("day"), F.min("day")).alias("span")
    )


@query(f"""{DRETS}, p AS (SELECT symbol, ts, CASE WHEN abs(ret) > 0.2 THEN sign(ret) ELSE 0 END AS pos FROM r), e AS (SELECT *, lag(pos, 1, 0) OVER (PARTITION BY symbol ORDER BY ts) AS was FROM p)
SELECT symbol, count(*) FILTER (pos <> 0) AS active, count(*) FILTER (pos <> 0 AND was = 0) AS episodes, count(*) FILTER (pos <> was) AS changes FROM e GROUP BY symbol""", "", "symbol active episodes changes")
def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Active bars, runs of them, and changes of the position."""
    p = _daily_returns(spark, sf).withColumn(
        "pos", F.expr("CASE WHEN abs(ret) > 0.2 THEN signum(ret) ELSE 0.0D END")
    ).withColumn("was", S.lagged("pos", 1, 0.0))
    n = lambda e: F.count_if(F.expr(e))
    return p.groupBy("symbol").agg(n("pos <> 0").alias("active"), n("pos <> 0 AND was = 0").alias("episodes"), n("pos <> was").alias("changes"))


# ---- windows


@query(f"""{DRETS}
SELECT symbol, ts, sum(coalesce(ret, 0)) OVER w AS cumsum, max(close) OVER w AS cummax, min(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS min_ahead, first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts)""", "cumsum cummax min_ahead bfill", "symbol ts")
def running(spark: SparkSession, sf: str) -> DataFrame:
    """Running sum and maximum, and what lies ahead: the least value to come and the next known one."""
    past, ahead = S.by_symbol().rowsBetween(W.unboundedPreceding, 0), S.by_symbol().rowsBetween(0, W.unboundedFollowing)
    return _daily_returns(spark, sf).select(
        "symbol", "ts", F.sum(F.coalesce("ret", F.lit(0.0))).over(past).alias("cumsum"), F.max("close").over(past).alias("cummax"),
        F.min("close").over(ahead).alias("min_ahead"), F.first("close", True).over(ahead).alias("bfill")
    )


@query(f"""{DRETS}, l AS (SELECT symbol, ts, ret, list(ret) OVER w AS v, count(ret) OVER w AS n FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 119 PRECEDING))
SELECT symbol, ts, CASE WHEN n >= 60 THEN len(list_filter(v, lambda x: x <= ret)) / n END AS place FROM l""", "place", "symbol ts")
def percent_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Where a value lies among the last 120, sixty at least: the window holds a bounded list."""
    l = _daily_returns(spark, sf).where("ret IS NOT NULL").select("symbol", "ts", "ret", F.collect_list("ret").over(S.trailing(120)).alias("v"))  # noqa: E741
    return l.select("symbol", "ts", F.expr("CASE WHEN size(v) >= 60 THEN size(filter(v, x -> x <= ret)) / size(v) END").alias("place"))


# ---- cross-sections


@query(f"""{RETS}, x AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY ret DESC, symbol DESC) AS dn, row_number() OVER (PARTITION BY ts ORDER BY ret, symbol) AS up, count(*) OVER (PARTITION BY ts) AS n FROM r WHERE ret IS NOT NULL AND fwd IS NOT NULL),
s AS (SELECT *, CAST(ceil(up * 5.0 / n) - 1 AS INTEGER) AS q FROM x WHERE n >= 10), w AS (SELECT *, ([-1.0, 0.5, 0.0, -0.5, 1.0])[q + 1] / count(*) OVER (PARTITION BY ts, q) AS raw FROM s)
SELECT ts, avg(CASE WHEN dn <= greatest(1, n // 5) THEN fwd END) AS top, avg(fwd) AS market, sum(raw * fwd) / sum(abs(raw)) AS shaped FROM w GROUP BY ts""", "top market shaped", "ts")
def quintile_books(spark: SparkSession, sf: str) -> DataFrame:
    """The top fifth alone, all alike, and weights that follow a shape over the fifths."""
    t = W.partitionBy("ts")
    x = _weekly_returns(spark, sf).where("ret IS NOT NULL AND fwd IS NOT NULL").withColumns(
        {
            "dn": F.row_number().over(t.orderBy(F.desc("ret"), F.desc("symbol"))), "up": F.row_number().over(t.orderBy("ret", "symbol")),
            "n": F.count("*").over(t)
        }
    )
    s = x.where("n >= 10").withColumn("q", F.expr("CAST(ceil(up * 5.0D / n) - 1 AS int)"))
    w = s.withColumn("raw", F.expr("element_at(array(-1.0D, 0.5D, 0.0D, -0.5D, 1.0D), q + 1)") / F.count("*").over(W.partitionBy("ts", "q")))
    return w.groupBy("ts").agg(
        F.avg(F.expr("CASE WHEN dn <= greatest(1, n DIV 5) THEN fwd END")).alias("top"), F.avg("fwd").alias("market"),
        F.expr("sum(raw * fwd) / sum(abs(raw))").alias("shaped")
    )


@query(f"""{RETS}, x AS (SELECT *, ret - avg(ret) OVER (PARTITION BY ts) AS a, stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vol, count(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS k FROM r WHERE ret IS NOT NULL),
p AS (SELECT *, a / (sum(abs(a)) OVER (PARTITION BY ts) + 1e-9) AS w FROM x), v AS (SELECT *, CASE WHEN k >= 20 THEN w / (vol + 1e-9) END AS s FROM p)
SELECT symbol, ts, w AS proportional, s / (sum(abs(s)) OVER (PARTITION BY ts) + 1e-9) AS scaled FROM v""", "proportional scaled", "symbol ts")
def proportional_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights in proportion to the signal, and those divided by the volatility of the twenty bars before."""
    before = S.by_symbol().rowsBetween(-20, -1)
    x = _weekly_returns(spark, sf).where("ret IS NOT NULL").withColumns(
        {"a": S.neutral("ret"), "vol": F.stddev_pop("ret").over(before), "k": F.count("ret").over(before)}
    )
    p = x.withColumn(
        "w", F.col("a") / (F.sum(F.abs("a")).over(S.by_time()) + 1e-9)
    ).withColumn("s", F.expr("CASE WHEN k >= 20 THEN w / (vol + 1e-9D) END"))
    return p.select("symbol", "ts", F.col("w").alias("proportional"), (F.col("s") / (F.sum(F.abs("s")).over(S.by_time()) + 1e-9)).alias("scaled"))


BETAS = f"""{RETS}, m AS (SELECT ts, avg(ret) AS mkt FROM r GROUP BY ts), jb AS (SELECT symbol, r.ts, ret, fwd, mkt FROM r JOIN m USING (ts) WHERE ret IS NOT NULL),
tb AS (SELECT symbol, ts, ret, fwd, CASE WHEN count(ret) OVER t >= 20 AND var_samp(mkt) OVER t > 0 THEN covar_samp(ret, mkt) OVER t / var_samp(mkt) OVER t END AS beta FROM jb WINDOW t AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))"""


def betas(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, ts, ret, fwd, beta to the mean of all over twenty bars."""
    r = _weekly_returns(spark, sf).select("symbol", "ts", "ret", "fwd")
    j = r.join(r.groupBy("ts").agg(F.avg("ret").alias("mkt")), "ts").where("ret IS NOT NULL")
    w = S.trailing(20)
    return j.withColumn("beta", F.when(F.count("ret").over(w) >= 20, F.try_divide(F.covar_samp("ret", "mkt").over(w), F.var_samp("mkt").over(w))))


@query(f"""{BETAS}, k AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY beta) + (count(*) OVER (PARTITION BY ts, beta) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY ts) AS n FROM tb WHERE beta IS NOT NULL),
d AS (SELECT *, quantile_cont(rk, 0.5) OVER (PARTITION BY ts) AS mid FROM k WHERE n >= 6),
s AS (SELECT *, CASE WHEN rk <= mid THEN 1 ELSE -1 END AS side, abs(rk - mid) + CASE WHEN rk = mid THEN 0.5 ELSE 0 END AS pull FROM d), l AS (SELECT *, pull / sum(pull) OVER (PARTITION BY ts, side) AS w0 FROM s),
b AS (SELECT *, sum(w0 * beta) OVER (PARTITION BY ts, side) AS leg FROM l), u AS (SELECT *, side * w0 / greatest(leg, 0.1) AS w1 FROM b)
SELECT symbol, ts, w1 / sum(abs(w1)) OVER (PARTITION BY ts) AS weight FROM u""", "weight", "symbol ts")
def betting_against_beta(spark: SparkSession, sf: str) -> DataFrame:
    """Low betas long, high ones short, each side scaled to the same beta, gross one."""
    t, leg = W.partitionBy("ts"), W.partitionBy("ts", "side")
    k = betas(spark, sf).where("beta IS NOT NULL").withColumns({"rk": S.average_rank("beta"), "n": F.count("*").over(t)}).where("n >= 6")
    d = k.withColumn("mid", F.percentile("rk", F.lit(0.5)).over(t)).withColumns(
        {"side": F.expr("CASE WHEN rk <= mid THEN 1 ELSE -1 END"), "pull": F.expr("abs(rk - mid) + CASE WHEN rk = mid THEN 0.5D ELSE 0.0D END")}
    )
    b = d.withColumn("w0", F.col("pull") / F.sum("pull").over(leg)).withColumn(
        "leg", F.sum(F.col("w0") * F.col("beta")).over(leg)
    ).withColumn("w1", F.expr("side * w0 / greatest(leg, 0.1D)"))
    return b.select("symbol", "ts", (F.col("w1") / F.sum(F.abs("w1")).over(t)).alias("weight"))


@query(f"""{WITH_C}, q AS (SELECT ts, symbol, avg((fut / spot - 1) * 365 / greatest(dte, 1)) AS ann FROM contracts WHERE dte BETWEEN 5 AND 85 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY ann DESC, symbol) AS dn, row_number() OVER (PARTITION BY ts ORDER BY ann, symbol DESC) AS up, count(*) OVER (PARTITION BY ts) AS n, count(*) FILTER (ann > 0) OVER (PARTITION BY ts) AS pos, count(*) FILTER (ann < 0) OVER (PARTITION BY ts) AS neg FROM q),
e AS (SELECT *, least(2, n // 2) AS h, CASE WHEN dn <= 2 AND ann > 0 THEN 1 WHEN up <= 2 AND ann < 0 THEN -1 ELSE 0 END AS x FROM k)
SELECT symbol, ts, CASE WHEN h = 0 THEN 0 WHEN dn <= h THEN 0.5 / h WHEN up <= h THEN -0.5 / h ELSE 0 END AS neutral, coalesce(x / nullif(sum(abs(x)) OVER (PARTITION BY ts), 0), 0) AS extremes, CASE WHEN ann > 0 THEN 1.0 / pos ELSE 0 END AS contango, CASE WHEN ann <> 0 THEN sign(ann) / (pos + neg) ELSE 0 END AS signed FROM e""", "neutral extremes contango signed", "symbol ts")
def carry_schemes(spark: SparkSession, sf: str) -> DataFrame:
    """Four ways to weigh coins by their basis: best against worst, extremes of either sign, all in contango, all by sign."""
    t = W.partitionBy("ts")
    q = P.contracts(spark, sf).where("dte BETWEEN 5 AND 85").groupBy("ts", "symbol").agg(
        F.avg(F.expr("(fut / spot - 1) * 365 / greatest(dte, 1)")).alias("ann")
    )
    k = q.withColumns(
        {
            "dn": F.row_number().over(t.orderBy(F.desc("ann"), "symbol")), "up": F.row_number().over(t.orderBy("ann", F.desc("symbol"))),
            "n": F.count("*").over(t), "pos": F.count_if(F.expr("ann > 0")).over(t), "neg": F.count_if(F.expr("ann < 0")).over(t)
        }
    )
    e = k.withColumns(
        {"h": F.expr("least(2, n DIV 2)"), "x": F.expr("CASE WHEN dn <= 2 AND ann > 0 THEN 1 WHEN up <= 2 AND ann < 0 THEN -1 ELSE 0 END")}
    )
    return e.select(
        "symbol", "ts", F.expr("CASE WHEN h = 0 THEN 0.0D WHEN dn <= h THEN 0.5D / h WHEN up <= h THEN -0.5D / h ELSE 0.0D END").alias("neutral"),
        F.coalesce(F.try_divide("x", F.sum(F.abs("x")).over(t)), F.lit(0.0)).alias("extremes"),
        F.expr("CASE WHEN ann > 0 THEN 1.0D / pos ELSE 0.0D END").alias("contango"),
        F.expr("CASE WHEN ann <> 0 THEN signum(ann) / (pos + neg) ELSE 0.0D END").alias("signed")
    )


@query(f"""{DRETS}, v AS (SELECT symbol, ts, CASE WHEN count(ret) OVER w >= 10 THEN stddev_samp(ret) OVER w END AS vol FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING))
SELECT ts, avg(vol) AS gauge, count(vol) AS n FROM v GROUP BY ts""", "gauge", "ts n")
def coin_gauge(spark: SparkSession, sf: str) -> DataFrame:
    """The mean over symbols of a measure of each."""
    return _daily_returns(spark, sf).select(
        "ts", S.rolling(F.stddev_samp, 10, "ret").alias("vol")
    ).groupBy("ts").agg(F.avg("vol").alias("gauge"), F.count("vol").alias("n"))


@query(f"""{DRETS}, l AS (SELECT symbol, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr FROM r GROUP BY symbol)
SELECT symbol, n, sr, row_number() OVER (ORDER BY coalesce(sr, -9) DESC, symbol) AS place FROM l""", "sr", "symbol n place")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols by their ratio, those without one last: one row a symbol."""
    l = _daily_returns(spark, sf).groupBy("symbol").agg(F.count("ret").alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"))  # noqa: E741
    return l.withColumn("place", F.row_number().over(W.orderBy(F.coalesce("sr", F.lit(-9.0)).desc(), "symbol")))


@query(f"""{WITH_D}, m AS (SELECT ts, map_from_entries(list((symbol, close) ORDER BY symbol)) AS prices FROM daily GROUP BY ts)
SELECT ts, cardinality(prices) AS n, coalesce(prices['AF'], 0) AS af, list_sum(map_values(prices)) AS total FROM m""", "af total", "ts n")
def price_maps(spark: SparkSession, sf: str) -> DataFrame:
    """A document of all prices of a day, written as JSON, read back and looked up."""
    m = P.daily(spark, sf).groupBy("ts").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "close")))).alias("prices"))
    back = m.select("ts", F.from_json(F.to_json("prices"), "map<string,double>").alias("prices"))
    return back.select(
        "ts", F.size("prices").cast("long").alias("n"), F.coalesce(F.try_element_at("prices", F.lit("AF")), F.lit(0.0)).alias("af"),
        F.aggregate(F.map_values("prices"), F.lit(0.0), lambda a, x: a + x).alias("total")
    )
