"""Scans of quotes and the paper book, on the last days of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.live import book as L
from riverbed.operators.stateful import ewm
from riverbed.plans.panel_ops import WITH_C
from riverbed.plans.registry import query
from riverbed.plans.research import WITH_D
from riverbed.sources import panels as P

#: The last bar of each coin on each venue at or before a day that lies so many days before the last.
LAG = 30

QUOTES = f"""{WITH_C}, q AS (SELECT symbol, substring(symbol, 1, 1) AS coin, substring(symbol, 2, 1) AS venue, code, max(ts) AS ts, arg_max(fut, ts) AS fut, arg_max(spot, ts) AS spot, arg_max(dte, ts) AS dte FROM contracts GROUP BY symbol, code),
lastday AS (SELECT max(ts) AS d FROM contracts), quotes AS (SELECT q.*, (fut / spot - 1) * 365 / dte AS ann FROM q, lastday WHERE dte > 1 AND date_diff('day', ts, d) <= {LAG})"""


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, coin, venue, code, ts, fut, spot, dte, ann: the last quote of each contract that still trades in the tables' last month."""
    c = P.contracts(spark, sf)
    last = lambda x: F.max_by(x, "ts").alias(x)
    q = c.groupBy("symbol", "code").agg(F.max("ts").alias("ts"), last("fut"), last("spot"), last("dte"))
    day = c.agg(F.max("ts").alias("_d"))
    live = q.join(F.broadcast(day), F.lit(True)).where(f"dte > 1 AND datediff(_d, ts) <= {LAG}")
    return live.select(
        "symbol", F.substring("symbol", 1, 1).alias("coin"), F.substring("symbol", 2, 1).alias("venue"), "code", "ts", "fut", "spot", "dte",
        F.expr("(fut / spot - 1) * 365 / dte").alias("ann")
    )


@query(f"""{QUOTES}
SELECT symbol, code, dte, ann, ann > 0.05 AND dte BETWEEN 20 AND 200 AS tradable, ann > 0.003 * 365 / 60 AND ann < 0.05 AS watched FROM quotes""", "ann", "symbol code dte tradable watched")
def basis_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts by basis: those to trade, and those that cover their costs without reaching the least basis."""
    return quotes(spark, sf).withColumns(
        {"tradable": F.expr("ann > 0.05 AND dte BETWEEN 20 AND 200"), "watched": F.expr("ann > 0.003D * 365 / 60 AND ann < 0.05")}
    )


@query(f"""{QUOTES}, b AS (SELECT coin, venue, code, dte, ann, row_number() OVER (PARTITION BY coin ORDER BY ann DESC, code, venue) AS place FROM quotes WHERE dte BETWEEN 20 AND 200 AND ann > 0.015),
s AS (SELECT coin, max(ann) AS hi, min(ann) AS lo, arg_max(venue, (ann, venue)) AS dear, arg_min(venue, (ann, venue)) AS cheap, count(DISTINCT venue) AS venues FROM quotes WHERE dte BETWEEN 2 AND 130 GROUP BY coin)
SELECT s.coin, b.venue, b.code, b.ann, hi - lo AS spread, dear, cheap, hi - lo > 0.005 AND venues > 1 AS apart FROM s LEFT JOIN b ON b.coin = s.coin AND place = 1""", "ann spread", "coin venue code dear cheap apart")
def venue_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Each coin's best contract over all venues, and how far the venues lie apart."""
    q = quotes(spark, sf)
    best = q.where("dte BETWEEN 20 AND 200 AND ann > 0.015").withColumn(
        "place", F.row_number().over(W.partitionBy("coin").orderBy(F.desc("ann"), "code", "venue"))
    ).where("place = 1").select("coin", "venue", "code", "ann")
    by = F.struct("ann", "venue")
    s = q.where("dte BETWEEN 2 AND 130").groupBy("coin").agg(
        F.max("ann").alias("hi"), F.min("ann").alias("lo"), F.max_by("venue", by).alias("dear"), F.min_by("venue", by).alias("cheap"),
        F.count_distinct("venue").alias("venues")
    )
    return s.join(best, "coin", "left").select(
        "coin", "venue", "code", "ann", F.expr("hi - lo").alias("spread"), "dear", "cheap", F.expr("hi - lo > 0.005 AND venues > 1").alias("apart")
    )


@query(f"""{WITH_D}, l AS (SELECT symbol, arg_max(funding, ts) AS funding, arg_max(qvol, ts) AS qvol FROM daily GROUP BY symbol), v AS (SELECT sum(qvol) / 7 AS least FROM l)
SELECT symbol, substring(symbol, 1, 1) AS coin, funding * 1e4 AS bp, funding * 3 * 365 * 100 AS annual, qvol / 1e6 AS volume, regexp_matches(symbol, 'N') AS tokenised FROM l, v WHERE qvol >= least""", "bp annual volume:8", "symbol coin tokenised")
def funding_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The last funding of symbols with enough volume."""
    l = P.daily(spark, sf).groupBy("symbol").agg(F.max_by("funding", "ts").alias("funding"), F.max_by("qvol", "ts").alias("qvol"))  # noqa: E741
    least = l.agg((F.sum("qvol") / 7).alias("least"))
    live = l.join(F.broadcast(least), F.expr("qvol >= least"))
    return live.select(
        "symbol", F.substring("symbol", 1, 1).alias("coin"), (F.col("funding") * 1e4).alias("bp"), (F.col("funding") * 3 * 365 * 100).alias("annual"),
        (F.col("qvol") / 1e6).alias("volume"), F.col("symbol").rlike("N").alias("tokenised")
    )


@query(f"""{WITH_D}, l AS (SELECT substring(symbol, 1, 1) AS coin, substring(symbol, 2, 1) AS venue, arg_max(funding, ts) AS f, count(*) AS bars FROM daily GROUP BY 1, 2)
SELECT coin, max(CASE WHEN venue = 'F' THEN f END) * 1e4 AS f_bp, max(CASE WHEN venue = 'O' THEN f END) * 1e4 AS o_bp, CAST(sum(bars) AS BIGINT) AS bars, CASE WHEN min(bars) >= 1500 AND count(*) = 2 THEN 'FULL' WHEN max(bars) > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS coverage FROM l GROUP BY coin""", "f_bp o_bp", "coin bars coverage")
def venue_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """Funding by venue side by side, and how complete each coin's history is."""
    l = P.daily(spark, sf).groupBy(  # noqa: E741
        F.substring("symbol", 1, 1).alias("coin"), F.substring("symbol", 2, 1).alias("venue")
    ).agg(F.max_by("funding", "ts").alias("f"), F.count("*").alias("bars"))
    side = l.groupBy("coin").pivot("venue", ["F", "O"]).agg(F.max("f"))
    n = l.groupBy("coin").agg(
        F.sum("bars").alias("bars"),
        F.expr("CASE WHEN min(bars) >= 1500 AND count(*) = 2 THEN 'FULL' WHEN max(bars) > 0 THEN 'PARTIAL' ELSE 'FAILED' END").alias("coverage")
    )
    return side.join(n, "coin").select("coin", (F.col("F") * 1e4).alias("f_bp"), (F.col("O") * 1e4).alias("o_bp"), "bars", "coverage")


def _snapshot_sql(before: int) -> str:
    s = f"s{before}"
    return f"""{s}d AS (SELECT max(ts) - INTERVAL {before} DAY AS d FROM daily), {s}l AS (SELECT symbol, arg_max(close, ts) AS px, arg_max(spot, ts) AS spot, arg_max(high, ts) AS fut, arg_max(funding, ts) AS funding, max(ts) AS ts FROM daily, {s}d WHERE ts <= d GROUP BY symbol),
{s}v AS (SELECT symbol, list(funding ORDER BY ts) AS v FROM daily, {s}d WHERE ts <= d GROUP BY symbol), {s}e AS (SELECT symbol, list_reduce(v, lambda a, x: 1.0 / 11 * x + 10.0 / 11 * a) AS ema FROM {s}v),
{s}n AS (SELECT substring(f.symbol, 1, 1) AS coin, f.px AS perp, f.spot AS spot, f.fut AS fut, round(e.ema, 12) AS funding, o.px AS other, o.funding AS other_funding, CAST(date_trunc('quarter', f.ts) + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS expiry, f.ts FROM {s}l f JOIN {s}e e ON e.symbol = f.symbol LEFT JOIN {s}l o ON substring(o.symbol, 1, 1) = substring(f.symbol, 1, 1) AND o.symbol LIKE '%O' WHERE f.symbol LIKE '%F'),
{s}c AS (SELECT *, strftime(expiry, '%y%m%d') AS code, (fut / spot - 1) * 365 / date_diff('day', ts, expiry) AS ann FROM {s}n),
{s}g AS (SELECT 'carry' AS sleeve, unnest(['PERP:' || coin, 'SPOT:' || coin]) AS instrument, unnest([CASE WHEN funding > 0 THEN -1.0 ELSE 1.0 END, CASE WHEN funding > 0 THEN 1.0 ELSE -1.0 END]) AS weight, unnest([FALSE, NOT funding > 0]) AS borrow FROM {s}c WHERE abs(funding) >= 1e-6
  UNION ALL SELECT 'calendar', unnest(['SPOT:' || coin, 'FUT:' || coin || '_' || code]), unnest([1.0, -1.0]), FALSE FROM {s}c WHERE ann > 0.05
  UNION ALL SELECT 'venue', unnest(['PERP:' || coin, 'OTHER:' || coin]), unnest([CASE WHEN funding - other_funding > 0 THEN -1.0 ELSE 1.0 END, CASE WHEN funding - other_funding > 0 THEN 1.0 ELSE -1.0 END]), FALSE FROM {s}c WHERE abs(funding - other_funding) >= 1e-6),
{s}k AS (SELECT sleeve, count(*) AS n FROM {s}g GROUP BY sleeve), {s}b AS (SELECT instrument, sum(weight * 3.0 / (SELECT count(*) FROM {s}k) / (n / 2) * 100000 * CASE WHEN borrow THEN 0.5 ELSE 1 END * 80.0 / 95) AS x FROM {s}g JOIN {s}k USING (sleeve) GROUP BY instrument),
{s}p AS (SELECT instrument, greatest(-50000, least(50000, x)) AS x FROM {s}b), {s}t AS (SELECT instrument, x * least(1.0, 300000 / (SELECT sum(abs(x)) FROM {s}p)) AS notional FROM {s}p),
{s}x AS (SELECT 'PERP:' || coin AS instrument, perp AS px FROM {s}c UNION ALL SELECT 'SPOT:' || coin, spot FROM {s}c UNION ALL SELECT 'FUT:' || coin || '_' || code, fut FROM {s}c UNION ALL SELECT 'OTHER:' || coin, other FROM {s}c WHERE other IS NOT NULL)"""


LIMITS = L.Limits(funding_threshold=1e-6)


def snapshot(spark: SparkSession, sf: str, before: int) -> tuple[DataFrame, DataFrame]:
    """(one row a coin with its signals, prices of all instruments), as known `before` days ahead of the last."""
    d = P.daily(spark, sf)
    day = d.agg(F.date_sub(F.max("ts"), before).alias("_d"))
    d = d.join(F.broadcast(day), F.expr("ts <= _d")).drop("_d")
    last = d.groupBy("symbol").agg(
        *[F.max_by(a, "ts").alias(b) for a, b in (("close", "px"), ("spot", "spot"), ("high", "fut"), ("funding", "last_funding"))],
        F.max("ts").alias("ts")
    )
    e = ewm(d, ["symbol"], "funding", 21).groupBy("symbol").agg(F.max_by("ema", "ts").alias("ema"))
    f = last.join(e, "symbol").where("symbol LIKE '%F'").select(
        F.substring("symbol", 1, 1).alias("coin"), F.col("px").alias("perp"), "spot", "fut", F.round("ema", 12).alias("funding"), "ts"
    )
    o = last.where("symbol LIKE '%O'").select(
        F.substring("symbol", 1, 1).alias("coin"), F.col("px").alias("other"), F.col("last_funding").alias("other_funding")
    )
    s = f.join(o, "coin", "left").withColumn("expiry", F.expr("date_sub(add_months(trunc(ts, 'quarter'), 6), 1)"))
    s = s.withColumns({"code": F.date_format("expiry", "yyMMdd"), "ann": F.expr("(fut / spot - 1) * 365 / datediff(expiry, ts)")})
    place = lambda kind, px: F.struct(F.concat(F.lit(f"{kind}:"), "coin").alias("instrument"), F.col(px).alias("px"))
    future = F.struct(F.concat(F.lit("FUT:"), "coin", F.lit("_"), "code").alias("instrument"), F.col("fut").alias("px"))
    return s, s.select(F.inline(F.array(place("PERP", "perp"), place("SPOT", "spot"), future, place("OTHER", "other")))).where("px IS NOT NULL")


def _vol(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(95.0,)], "vol double")


@query(f"""{WITH_D}, {_snapshot_sql(0)}
SELECT sleeve, instrument, weight, borrow FROM s0g""", "weight", "sleeve instrument borrow")
def sleeve_legs(spark: SparkSession, sf: str) -> DataFrame:
    return L.legs(snapshot(spark, sf, 0)[0], LIMITS)


@query(f"""{WITH_D}, {_snapshot_sql(0)}
SELECT instrument, notional FROM s0t""", "notional:4", "instrument")
def target_book(spark: SparkSession, sf: str) -> DataFrame:
    return L.targets(L.legs(snapshot(spark, sf, 0)[0], LIMITS), _vol(spark), LIMITS)


_CYCLE = f"""{WITH_D}, {_snapshot_sql(LAG)}, {_snapshot_sql(0)}, st AS (SELECT instrument, notional / px AS qty, px AS last_px FROM s{LAG}t JOIN s{LAG}x USING (instrument) WHERE abs(notional) >= 1)"""


def _state(spark: SparkSession, sf: str) -> DataFrame:
    s, px = snapshot(spark, sf, LAG)
    empty = spark.createDataFrame([], "instrument string, qty double, last_px double")
    return L.cycle(s, px, _vol(spark), empty, LIMITS)["state"]


@query(f"""{_CYCLE}, j AS (SELECT coalesce(st.instrument, t.instrument) AS instrument, coalesce(qty, 0) AS old, notional, px FROM st FULL JOIN s0t t ON st.instrument = t.instrument LEFT JOIN s0x x ON x.instrument = coalesce(st.instrument, t.instrument)),
o AS (SELECT *, notional / px - old AS ch, notional IS NULL AND old <> 0 AS closed, coalesce(notional IS NOT NULL AND px > 0 AND abs((notional / px - old) * px) >= 1, FALSE) AS traded FROM j)
SELECT instrument, CASE WHEN closed THEN 'CLOSE' WHEN traded AND ch > 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN closed THEN -old ELSE ch END AS qty, px, CASE WHEN traded THEN abs(ch * px) * 5 / 1e4 ELSE 0 END AS cost FROM o WHERE closed OR traded""", "qty:4 px cost:4", "instrument side")
def rebalance_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders from the book of a month ago to today's."""
    s, px = snapshot(spark, sf, 0)
    return L.cycle(s, px, _vol(spark), _state(spark, sf), LIMITS)["orders"]


@query(f"""{_CYCLE}
SELECT coalesce(sum(qty * (x.px - last_px)), 0) AS pnl, count(*) AS marked FROM st JOIN s0x x USING (instrument)""", "pnl:3", "marked")
def mark_to_market(spark: SparkSession, sf: str) -> DataFrame:
    """What the positions of a month ago gained to today's prices."""
    state, px = _state(spark, sf), snapshot(spark, sf, 0)[1]
    return L.marked(state, px).join(state.join(px, "instrument").agg(F.count("*").alias("marked")), F.lit(True))


@query(f"""{WITH_D}, {_snapshot_sql(0)}
SELECT count(*) AS legs, sum(abs(notional)) / 100000 AS gross, sum(notional) AS net, 80.0 / 95 AS breaker FROM s0t""", "gross net:3 breaker", "legs")
def book_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """The book in one row: gross within its limit, net near nothing."""
    return target_book(spark, sf).agg(
        F.count("*").alias("legs"), (F.sum(F.abs("notional")) / LIMITS.capital).alias("gross"), F.sum("notional").alias("net"),
        F.lit(LIMITS.calm_vol / 95).alias("breaker")
    )
