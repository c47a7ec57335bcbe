"""Sleeves, books and the strategies built of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions import series as S
from riverbed.operators import books
from riverbed.operators import stateful as T
from riverbed.plans.backtests import GENTLE, METRICS, evaluated, gentle
from riverbed.plans.machines import hedged_scores
from riverbed.plans.panel_ops import BETAS, HELD_SQL, WITH_B, WITH_C, basis_or_funding, betas
from riverbed.plans.registry import query
from riverbed.plans.research import RETS, WITH_D, _weekly_returns
from riverbed.sources import panels as P

SPANS, BANDS = (3, 9, 21), (0.0, 0.5, 1.0, 2.0)
_SPLIT = "CASE WHEN row_number() OVER (PARTITION BY name ORDER BY ts) <= floor(count(*) OVER (PARTITION BY name) * 0.6) THEN 'is' ELSE 'oos' END AS split"

#: Carry of each symbol under every span and threshold, both legs charged.
CARRY = f"""{GENTLE}, fl AS (SELECT symbol, list(funding ORDER BY ts) AS v, list(ts ORDER BY ts) AS t FROM g GROUP BY symbol),
em AS (SELECT symbol, span, t[i] AS ts, list_reduce(v[:i], lambda a, x: 2.0 / (span + 1) * x + (1 - 2.0 / (span + 1)) * a) AS e FROM fl, (SELECT unnest([3, 9, 21]) AS span), unnest(generate_series(1, len(v))) AS q(i)),
el AS (SELECT symbol, span, ts, coalesce(lag(e) OVER (PARTITION BY symbol, span ORDER BY ts), 0) AS e FROM em),
st AS (SELECT symbol, span, thr, ts, coalesce(last_value(CASE WHEN e > thr / 1e4 THEN 1.0 WHEN e < -thr / 1e4 THEN -1.0 WHEN abs(e) < thr / 3e4 THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY symbol, span, thr ORDER BY ts), 0) AS pos FROM el, (SELECT unnest([0.0, 0.5, 1.0, 2.0]) AS thr)),
cn AS (SELECT symbol, span, thr, ts, pos, pos * (funding + sret - ret) - 2 * abs(pos - lag(pos, 1, 0) OVER (PARTITION BY symbol, span, thr ORDER BY ts)) * 5 / 1e4 AS net FROM st JOIN g USING (symbol, ts))"""


def carry_grid(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, span, thr, ts, pos, net: hysteresis on smoothed funding over the grid, variants as rows."""
    g = gentle(spark, sf)
    e = T.ewm_grid(g, ["symbol"], "funding", SPANS).withColumns({f"e{s}": S.lagged(f"e{s}", 1, 0.0) for s in SPANS})
    cells = F.array(*[F.struct(F.lit(s).alias("span"), F.lit(b).alias("thr"), F.col(f"e{s}").alias("e")) for s in SPANS for b in BANDS])
    rows = e.join(g, ["symbol", "ts"]).select("symbol", "ts", F.expr("funding + sret - ret").alias("unit"), F.inline(cells))
    by = W.partitionBy("symbol", "span", "thr").orderBy("ts")
    decided = F.expr("CASE WHEN e > thr / 1e4D THEN 1.0D WHEN e < -thr / 1e4D THEN -1.0D WHEN abs(e) < thr / 3e4D THEN 0.0D END")
    rows = rows.withColumn("d", decided).withColumn("pos", F.coalesce(F.last("d", True).over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))
    turn = F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(by))
    return rows.select("symbol", "span", "thr", "ts", "pos", (F.col("pos") * F.col("unit") - 2 * turn * 5 / 1e4).alias("net"))


@query(f"""{CARRY}, nets AS (SELECT symbol || '/' || span || '/' || thr AS name, 365 AS ppy, ts, pos, net, CASE WHEN row_number() OVER (PARTITION BY symbol, span, thr ORDER BY ts) <= floor(count(*) OVER (PARTITION BY symbol, span, thr) * 0.6) THEN 'is' ELSE 'oos' END AS split, symbol, span, thr FROM cn), {METRICS},
kk AS (SELECT DISTINCT name, symbol, span, thr FROM nets), b AS (SELECT symbol, arg_max(name, (round(sr_pp, 9), -span, -thr)) AS name FROM met JOIN kk USING (name) WHERE split = 'is' GROUP BY symbol)
SELECT symbol, kk.span, kk.thr, n, sr_pp, ret_ann, turnover FROM b JOIN met USING (name) JOIN kk USING (symbol, name) WHERE split = 'oos'""", "thr sr_pp ret_ann turnover", "symbol span n")
def carry_tuned(spark: SparkSession, sf: str) -> DataFrame:
    """Carry of each symbol with the span and threshold that did best in sample; the first of equals."""
    m = evaluated(carry_grid(spark, sf), ["symbol", "span", "thr"], 365)
    best = m.where("split = 'is'").groupBy("symbol").agg(
        F.max_by(F.struct("span", "thr"), F.struct(F.round("sr_pp", 9), -F.col("span"), -F.col("thr"))).alias("b")
    ).select("symbol", "b.*")
    return m.where("split = 'oos'").join(best, ["symbol", "span", "thr"])


SLEEVES = f"""{CARRY}, funding_sleeve AS (SELECT 'funding' AS sleeve, ts, avg(net) AS net FROM cn WHERE span = 9 AND thr = 1.0 GROUP BY ts),
cs0 AS (SELECT symbol, ts, spot, CASE k WHEN 0 THEN close ELSE high END AS fut, CAST(date_trunc('quarter', ts) + to_months(CAST(3 * k + 3 AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS expiry FROM daily, (SELECT unnest([0, 1]) AS k)),
cs AS (SELECT *, date_diff('day', ts, expiry) AS dte FROM cs0),
bu AS (SELECT symbol, expiry, ts, coalesce(spot / lag(spot) OVER w - fut / lag(fut) OVER w, 0) / 100 AS unit, count(*) OVER (PARTITION BY symbol, expiry) AS held FROM cs WHERE dte BETWEEN 5 AND 85 WINDOW w AS (PARTITION BY symbol, expiry ORDER BY ts)),
basis_sleeve AS (SELECT 'basis' AS sleeve, ts, avg(unit - 30 / 1e4 / held) AS net FROM bu GROUP BY ts), basis_free AS (SELECT 'basis' AS sleeve, ts, avg(unit) AS net FROM bu GROUP BY ts),
vf AS (SELECT substring(symbol, 1, 1) AS coin, ts, sum(CASE WHEN symbol LIKE '%F' THEN funding END) AS f, sum(CASE WHEN symbol LIKE '%O' THEN funding END) AS o FROM daily GROUP BY 1, 2),
vd AS (SELECT coin, ts, f - o AS d FROM vf WHERE f IS NOT NULL AND o IS NOT NULL), vl AS (SELECT coin, list(d ORDER BY ts) AS v, list(ts ORDER BY ts) AS t FROM vd GROUP BY coin),
ve AS (SELECT coin, t[i] AS ts, v[i] AS d, list_reduce(v[:i], lambda a, x: 1.0 / 3 * x + 2.0 / 3 * a) AS e FROM vl, unnest(generate_series(1, len(v))) AS q(i)), vg AS (SELECT coin, ts, d, coalesce(lag(e) OVER (PARTITION BY coin ORDER BY ts), 0) AS e FROM ve),
vp AS (SELECT coin, ts, d, coalesce(last_value(CASE WHEN e > 1e-4 THEN 1.0 WHEN e < -1e-4 THEN -1.0 WHEN abs(e) < 1e-4 / 3 THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY coin ORDER BY ts), 0) AS pos FROM vg),
vn AS (SELECT coin, ts, pos * d - 2 * abs(pos - lag(pos, 1, 0) OVER (PARTITION BY coin ORDER BY ts)) * 5 / 1e4 AS net FROM vp), venue_sleeve AS (SELECT 'venue' AS sleeve, ts, avg(net) AS net FROM vn GROUP BY ts),
iv AS (SELECT ts, avg(ret) AS r, stddev_samp(avg(ret)) OVER (ORDER BY ts ROWS 29 PRECEDING) * sqrt(365) AS iv FROM g GROUP BY ts), vrp_sleeve AS (SELECT 'vrp' AS sleeve, ts, (lag(iv) OVER (ORDER BY ts) ** 2 / 365 - r * r) * 20 AS net FROM iv)"""


def funding_sleeve(spark: SparkSession, sf: str) -> DataFrame:
    """ts, net: the mean over symbols of carry with fixed parameters."""
    return carry_grid(spark, sf).where("span = 9 AND thr = 1.0").groupBy("ts").agg(F.avg("net").alias("net"))


def basis_sleeve(spark: SparkSession, sf: str, round_trip_bp: float = 30.0) -> DataFrame:
    """ts, net: the mean spread of all contracts held, costs spread evenly over the days that each is held; none at zero basis points."""
    by = W.partitionBy("symbol", "expiry")
    c = P.contracts(spark, sf).where("dte BETWEEN 5 AND 85")
    prior = lambda x: F.lag(x).over(by.orderBy("ts"))
    unit = F.coalesce(F.col("spot") / prior("spot") - F.col("fut") / prior("fut"), F.lit(0.0)) / 100
    return c.withColumns({"unit": unit, "held": F.count("*").over(by)}).groupBy("ts").agg(
        F.avg(F.col("unit") - round_trip_bp / 1e4 / F.col("held")).alias("net")
    )


def venue_sleeve(spark: SparkSession, sf: str) -> DataFrame:
    """ts, net: hysteresis on the funding of one venue less the other's, two legs."""

    v = P.daily(spark, sf).groupBy(F.substring("symbol", 1, 1).alias("symbol"), "ts").agg(
        *[F.sum(F.when(F.col("symbol").endswith(x), F.col("funding"))).alias(x) for x in "FO"]
    ).where("F IS NOT NULL AND O IS NOT NULL").withColumn("d", F.expr("F - O"))
    e = T.ewm(v, ["symbol"], "d", 5, "v").withColumn("e", S.lagged("v", 1, 0.0)).join(v.select("symbol", "ts", "d"), ["symbol", "ts"])
    p = e.withColumn("pos", T.latest(F.expr("CASE WHEN e > 1e-4D THEN 1.0D WHEN e < -1e-4D THEN -1.0D WHEN abs(e) < 1e-4D / 3 THEN 0.0D END"), 0.0))
    return p.withColumn(
        "net", F.col("pos") * F.col("d") - 2 * F.abs(F.col("pos") - S.lagged("pos", 1, 0.0)) * 5 / 1e4
    ).groupBy("ts").agg(F.avg("net").alias("net"))


def vrp_sleeve(spark: SparkSession, sf: str) -> DataFrame:
    """ts, net: yesterday's implied variance of a day less the squared move, twenty times; implied volatility is that of the last thirty days. One row a day."""
    w = W.orderBy("ts")
    m = gentle(spark, sf).groupBy("ts").agg(F.avg("ret").alias("r")).withColumn("iv", F.stddev_samp("r").over(w.rowsBetween(-29, 0)) * 365**0.5)
    return m.select("ts", ((F.pow(F.lag("iv").over(w), 2) / 365 - F.col("r") * F.col("r")) * 20).alias("net"))


def _named(streams: dict[str, DataFrame]) -> DataFrame:
    every = [s.select(F.lit(k).alias("sleeve"), "ts", "net") for k, s in streams.items()]
    out = every[0]
    for s in every[1:]:
        out = out.unionByName(s)
    return out.where("net IS NOT NULL")


@query(f"""{SLEEVES}
SELECT * FROM funding_sleeve UNION ALL SELECT * FROM basis_sleeve UNION ALL SELECT * FROM venue_sleeve UNION ALL SELECT * FROM vrp_sleeve WHERE net IS NOT NULL""", "net:9", "sleeve ts")
def sleeves(spark: SparkSession, sf: str) -> DataFrame:
    """Four sources of return by day."""
    return _named(
        {"funding": funding_sleeve(spark, sf), "basis": basis_sleeve(spark, sf), "venue": venue_sleeve(spark, sf), "vrp": vrp_sleeve(spark, sf)}
    )


def _combined(scale: str) -> str:
    return f"""tm AS (SELECT ts, percent_rank() OVER (ORDER BY ts) AS p FROM (SELECT DISTINCT ts FROM every)), ct AS (SELECT max(ts) AS cut FROM tm WHERE p < 0.6),
inv AS (SELECT sleeve, 1 / stddev_samp(net) AS i FROM every, ct WHERE ts <= cut AND net <> 0 GROUP BY sleeve), mx AS (SELECT ts, ts <= any_value(cut) AS ins, sum(net * i / (SELECT sum(i) FROM inv)) AS mix FROM every JOIN inv USING (sleeve), ct GROUP BY ts),
vl2 AS (SELECT stddev_samp(mix) * sqrt(365) AS vol FROM mx WHERE ins)
SELECT ts, mix * {scale} AS net FROM mx, vl2"""


@query(
    f"""{SLEEVES}, every AS (SELECT * FROM funding_sleeve UNION ALL SELECT * FROM basis_sleeve UNION ALL SELECT * FROM venue_sleeve), {_combined("CASE WHEN vol > 1e-4 THEN least(0.1 / vol, 4.0) ELSE 1.0 END")}""",
    "net:9", "ts"
)
def carry_book(spark: SparkSession, sf: str) -> DataFrame:
    """Three sleeves by inverse volatility, brought to ten per cent a year, four times at most."""
    return books.inverse_vol(
        _named({"funding": funding_sleeve(spark, sf), "basis": basis_sleeve(spark, sf), "venue": venue_sleeve(spark, sf)}), "sleeve", 0.1, 365, 4.0
    )


_DEPLOY = f"{SLEEVES}, every0 AS (SELECT * FROM funding_sleeve UNION ALL SELECT * FROM basis_free UNION ALL SELECT * FROM vrp_sleeve WHERE net IS NOT NULL), lv AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT sleeve, min(ts) AS a, max(ts) AS b FROM every0 GROUP BY sleeve)), every AS (SELECT sleeve, ts, net FROM every0, lv WHERE ts BETWEEN a AND b)"


def deployed(spark: SparkSession, sf: str) -> DataFrame:
    from riverbed.operators.joins import common_window

    every = _named({"funding": funding_sleeve(spark, sf), "basis": basis_sleeve(spark, sf, 0.0), "vrp": vrp_sleeve(spark, sf)})
    return books.inverse_vol(common_window(every, "sleeve"), "sleeve", 0.1, 365)


@query(f"""{_DEPLOY}, {_combined("CASE WHEN vol > 1e-4 THEN 0.1 / vol ELSE 1.0 END")}""", "net:9", "ts")
def deploy_book(spark: SparkSession, sf: str) -> DataFrame:
    """Three sleeves over the time in which all live, at ten per cent a year; the basis is not charged here."""
    return deployed(spark, sf)


@query(f"""{HELD_SQL}, pb AS (SELECT ts, avg(stream) / 400 AS net FROM held GROUP BY ts), lev AS (SELECT 'x' || k AS name, 365 AS ppy, ts, CAST(NULL AS DOUBLE) AS pos, net * k AS net FROM pb, (SELECT unnest([1, 3]) AS k)), nets AS (SELECT *, {_SPLIT} FROM lev), {METRICS}
SELECT name, split, n, sharpe_ann, ret_ann, vol_ann, maxdd, hit FROM met""", "sharpe_ann ret_ann vol_ann maxdd hit", "name split n")
def playbook(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts where one qualifies, funding elsewhere, all coins alike, once and three times."""
    pb = basis_or_funding(spark, sf).groupBy("ts").agg((F.avg("stream") / 400).alias("b"))
    lev = pb.select(
        "ts", F.inline(F.array(*[F.struct(F.lit(f"x{k}").alias("name"), (F.col("b") * k).alias("net")) for k in (1, 3)]))
    ).withColumn("pos", F.lit(None).cast("double"))
    return evaluated(lev, ["name"], 365)


@query(f"""{HELD_SQL}, pb AS (SELECT ts, avg(stream) / 400 AS net FROM held GROUP BY ts)
SELECT ts, exp(sum(ln(1 + net)) OVER (ORDER BY ts)) AS once, exp(sum(ln(1 + 3 * net)) OVER (ORDER BY ts)) AS thrice FROM pb""", "once thrice", "ts")
def equity_curves(spark: SparkSession, sf: str) -> DataFrame:
    """What one becomes, by day: the data of a figure."""
    pb = basis_or_funding(spark, sf).groupBy("ts").agg((F.avg("stream") / 400).alias("b"))
    curve = lambda k: F.exp(F.sum(F.log1p(k * F.col("b"))).over(W.orderBy("ts")))
    return pb.select("ts", curve(1).alias("once"), curve(3).alias("thrice"))


@query(f"""{WITH_C}, q AS (SELECT *, (fut / spot - 1) * 365 / greatest(dte, 1) AS ann, row_number() OVER w AS rn, ln(spot / lag(spot) OVER w) / 100 AS rs, ln(fut / lag(fut) OVER w) / 100 AS rf FROM contracts WHERE dte BETWEEN 5 AND 85 WINDOW w AS (PARTITION BY symbol, code ORDER BY ts)),
t AS (SELECT symbol, code, count(*) AS n, arg_min(ann, ts) AS entry, avg(ann) AS mean, sum(coalesce(rs - rf, 0)) AS earned, count(*) FILTER (ann > 0) * 1.0 / count(*) AS contango FROM q GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT symbol, code, n, entry, mean, earned, earned - 0.003 AS net, contango, entry > 0.003 * 365 / 80 AS taken FROM t""", "entry mean earned net contango", "symbol code n taken")
def basis_spec(spark: SparkSession, sf: str) -> DataFrame:
    """Each contract between 85 and 5 days: entry and mean basis, what the spread earned before and after thirty basis points, and whether the entry passes the hurdle."""
    by = W.partitionBy("symbol", "code").orderBy("ts")
    q = P.contracts(spark, sf).where("dte BETWEEN 5 AND 85").withColumns(
        {
            "ann": F.expr("(fut / spot - 1) * 365 / greatest(dte, 1)"), "rs": F.log(F.col("spot") / F.lag("spot").over(by)) / 100,
            "rf": F.log(F.col("fut") / F.lag("fut").over(by)) / 100
        }
    )
    t = q.groupBy("symbol", "code").agg(
        F.count("*").alias("n"), F.min_by("ann", "ts").alias("entry"), F.avg("ann").alias("mean"),
        F.sum(F.coalesce(F.col("rs") - F.col("rf"), F.lit(0.0))).alias("earned"), F.avg((F.col("ann") > 0).cast("double")).alias("contango")
    ).where("n >= 10")
    return t.withColumns({"net": F.col("earned") - 0.003, "taken": F.col("entry") > 0.003 * 365 / 80})


@query(f"""{WITH_C}, c AS (SELECT *, (fut / spot - 1) AS basis, max(dte) OVER (PARTITION BY symbol, code) AS first_dte FROM contracts WHERE dte <= 210), t AS (SELECT symbol, code, count(*) AS n, arg_min(basis, ts) AS entry, arg_max(basis, ts) AS final, any_value(first_dte) AS days FROM c GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT symbol, code, n, entry, final, entry - final - 0.003 AS net, (entry - final - 0.003) * 365 / greatest(days, 1) AS annual, entry > 0.003 AS conditional FROM t""", "entry final net annual", "symbol code n conditional")
def calendar_basis(spark: SparkSession, sf: str) -> DataFrame:
    """Each contract from its first day within 210 to its last: what the basis pays, and whether entry alone covers the costs."""
    c = P.contracts(spark, sf).where("dte <= 210").withColumn("basis", F.expr("fut / spot - 1"))
    t = c.groupBy("symbol", "code").agg(
        F.count("*").alias("n"), F.min_by("basis", "ts").alias("entry"), F.max_by("basis", "ts").alias("final"), F.max("dte").alias("days")
    ).where("n >= 20")
    net = F.col("entry") - F.col("final") - 0.003
    return t.withColumns({"net": net, "annual": net * 365 / F.greatest("days", F.lit(1)), "conditional": F.col("entry") > 0.003})


_SCHEMES = """q AS (SELECT ts, symbol, avg((fut / spot - 1) * 365 / greatest(dte, 1)) AS ann, avg(spot) AS spot, avg(fut) AS fut FROM contracts WHERE dte BETWEEN 5 AND 85 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY ann DESC, symbol) AS dn, row_number() OVER (PARTITION BY ts ORDER BY ann, symbol DESC) AS up, count(*) OVER (PARTITION BY ts) AS n, count(*) FILTER (ann > 0) OVER (PARTITION BY ts) AS pos FROM q),
wt AS (SELECT symbol, ts, CASE WHEN least(2, n // 2) = 0 THEN 0.0 WHEN dn <= least(2, n // 2) THEN 0.5 / least(2, n // 2) WHEN up <= least(2, n // 2) THEN -0.5 / least(2, n // 2) ELSE 0.0 END AS a, CASE WHEN ann > 0 THEN 1.0 / pos ELSE 0 END AS b,
  CAST(ts + CAST((12 - dayofweek(ts)) % 7 AS INTEGER) AS DATE) AS week, coalesce(spot / lag(spot) OVER w - fut / lag(fut) OVER w, 0) / 100 AS unit FROM k WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@query(f"""{WITH_C}, {_SCHEMES}, lw AS (SELECT *, CASE WHEN lead(week) OVER (PARTITION BY symbol ORDER BY ts) IS DISTINCT FROM week THEN 1 END AS last_ FROM wt),
hw AS (SELECT symbol, ts, unit, unnest(['neutral', 'contango']) AS scheme, unnest([CASE WHEN last_ = 1 THEN a END, CASE WHEN last_ = 1 THEN b END]) AS m FROM lw),
hh AS (SELECT symbol, ts, scheme, unit, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY symbol, scheme ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM hw)
SELECT scheme, ts, sum(w * unit) - 15 / 1e4 * sum(tn) AS net, sum(abs(w)) AS gross FROM (SELECT *, abs(w - lag(w, 1, 0) OVER (PARTITION BY symbol, scheme ORDER BY ts)) AS tn FROM hh) GROUP BY scheme, ts""", "net gross", "scheme ts")
def weekly_carry(spark: SparkSession, sf: str) -> DataFrame:
    """Carry weights of two schemes, set on the last day of each week, held from the next, at fifteen basis points a turn."""
    t = W.partitionBy("ts")
    q = P.contracts(spark, sf).where("dte BETWEEN 5 AND 85").groupBy("ts", "symbol").agg(
        F.avg(F.expr("(fut / spot - 1) * 365 / greatest(dte, 1)")).alias("ann"), F.avg("spot").alias("spot"), F.avg("fut").alias("fut")
    )
    k = q.withColumns(
        {
            "dn": F.row_number().over(t.orderBy(F.desc("ann"), "symbol")), "up": F.row_number().over(t.orderBy("ann", F.desc("symbol"))),
            "n": F.count("*").over(t), "pos": F.count_if(F.expr("ann > 0")).over(t)
        }
    )
    h = "least(2, n DIV 2)"
    k = k.withColumns(
        {
            "neutral": F.expr(f"CASE WHEN {h} = 0 THEN 0.0D WHEN dn <= {h} THEN 0.5D / {h} WHEN up <= {h} THEN -0.5D / {h} ELSE 0.0D END"),
            "contango": F.expr("CASE WHEN ann > 0 THEN 1.0D / pos ELSE 0.0D END"),
            "unit": F.coalesce(F.col("spot") / S.lagged("spot") - F.col("fut") / S.lagged("fut"), F.lit(0.0)) / 100
        }
    )
    out = [books.book(books.weekly_hold(k, s), "unit", 15).withColumn("scheme", F.lit(s)) for s in ("neutral", "contango")]
    return out[0].unionByName(out[1])


_LOWVOL = f"""{BETAS}, v AS (SELECT symbol, ts, ret, fwd, beta, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END AS vol FROM tb WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
rk AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY -vol) + (count(*) OVER (PARTITION BY ts, vol) - 1) / 2.0 AS rk FROM v WHERE vol IS NOT NULL), dm AS (SELECT *, rk - avg(rk) OVER (PARTITION BY ts) AS d FROM rk),
wt AS (SELECT symbol, ts, ret, i, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY ts), 0), 0) AS w FROM dm), hd AS (SELECT symbol, ts, ret, last_value(CASE WHEN i % 4 = 0 THEN w END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS h FROM wt),
lg AS (SELECT symbol, ts, ret, lag(coalesce(h, 0), 1, 0) OVER w AS w1, lag(coalesce(h, 0), 2, 0) OVER w AS w2, row_number() OVER w AS rn FROM hd WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
bk AS (SELECT ts, (sum(w1 * ret) - 5 / 1e4 * sum(CASE WHEN rn = 1 THEN 0 ELSE abs(w1 - w2) END)) / 10 AS net, sum(abs(w1)) AS pos FROM lg GROUP BY ts)"""


def low_vol_book(spark: SparkSession, sf: str) -> DataFrame:
    """ts, net, gross: calm symbols long, wild ones short by rank, renewed every four weeks, a week later; a tenth, so that it compounds."""
    v = betas(spark, sf).withColumn("vol", S.rolling(F.stddev_samp, 20, "ret")).withColumn(
        "i", F.row_number().over(S.by_symbol()) - 1
    ).where("vol IS NOT NULL").withColumn("calm", -F.col("vol"))
    w = books.rank_weights(v, "calm")
    held = w.withColumn("m", F.expr("CASE WHEN i % 4 = 0 THEN w END")).withColumn(
        "w", F.last("m", True).over(S.by_symbol().rowsBetween(W.unboundedPreceding, 0))
    )
    return books.book(held, "ret", 5, lag=1, first_free=True).select("ts", (F.col("net") / 10).alias("net"), F.col("gross").alias("pos"))


@query(f"""{_LOWVOL}, lead_ AS (SELECT ts, avg(ret) / 10 AS mkt FROM r GROUP BY ts), jn AS (SELECT bk.ts, net, pos, mkt FROM bk JOIN lead_ USING (ts)), sp AS (SELECT *, row_number() OVER (ORDER BY ts) <= floor(count(*) OVER () * 0.6) AS ins FROM jn),
be AS (SELECT covar_samp(net, mkt) / var_pop(mkt) AS beta FROM sp WHERE ins)
SELECT ts, net, net - beta * mkt AS hedged, pos FROM sp, be""", "net hedged pos", "ts")
def low_vol(spark: SparkSession, sf: str) -> DataFrame:
    """The book, and what is left after its in-sample beta to the mean of all: one row a week, one row for the beta."""
    r = _weekly_returns(spark, sf).groupBy("ts").agg((F.avg("ret") / 10).alias("mkt"))
    j = low_vol_book(spark, sf).join(r, "ts")
    n = F.count("*").over(W.partitionBy())
    j = j.withColumn("ins", F.row_number().over(W.orderBy("ts")) <= F.floor(n * 0.6))
    beta = j.where("ins").agg(F.try_divide(F.covar_samp("net", "mkt"), F.var_pop("mkt")).alias("beta"))
    return j.join(F.broadcast(beta), F.lit(True)).withColumn("hedged", F.expr("net - beta * mkt"))


@query(f"""{RETS}, a AS (SELECT symbol, ts, ret, fwd, CASE WHEN count(ret) OVER w >= 10 THEN avg(abs(ret) / qvol * 1e6) OVER w END AS illiq FROM r WHERE ret IS NOT NULL AND qvol > 0 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING)),
rk AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY illiq) + (count(*) OVER (PARTITION BY ts, illiq) - 1) / 2.0 AS rk FROM a WHERE illiq IS NOT NULL), dm AS (SELECT *, rk - avg(rk) OVER (PARTITION BY ts) AS d FROM rk),
wt AS (SELECT symbol, ts, coalesce(fwd, 0) AS fwd, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY ts), 0), 0) AS w FROM dm), tn AS (SELECT *, abs(w - lag(w, 1, 0) OVER (PARTITION BY symbol ORDER BY ts)) AS t FROM wt)
SELECT bps AS long_bps, ts, sum(w * fwd) - sum(t * CASE WHEN w > 0 THEN bps WHEN w < 0 THEN 5 ELSE 0 END) / 1e4 AS net FROM tn, (SELECT unnest([15, 20, 25]) AS bps) GROUP BY bps, ts""", "net", "long_bps ts")
def illiquidity(spark: SparkSession, sf: str) -> DataFrame:
    """Long what moves most for its volume, short what moves least; longs cost more."""
    r = _weekly_returns(spark, sf).where("ret IS NOT NULL AND qvol > 0").withColumn("x", F.expr("abs(ret) / qvol * 1e6D"))
    a = r.withColumn("illiq", F.when(F.count("ret").over(S.trailing(10)) >= 10, F.avg("x").over(S.trailing(10)))).where("illiq IS NOT NULL")
    w = books.rank_weights(a, "illiq")
    out = [books.uneven_book(w, "fwd", b, 5).withColumn("long_bps", F.lit(b)) for b in (15, 20, 25)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""{GENTLE}, mk AS (SELECT ts, avg(ret) AS r FROM g GROUP BY ts), vv AS (SELECT ts, r, sqrt(avg(r * r) OVER (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) AS fc, row_number() OVER (ORDER BY ts) AS rn FROM mk)
SELECT band, ts, fc * fc - r * r AS gamma, CASE WHEN abs(r) > band * fc THEN -5 / 1e4 ELSE 0 END AS hedge_cost FROM vv, (SELECT unnest([1.0, 2.0]) AS band) WHERE rn > 24""", "band gamma:9 hedge_cost", "ts")
def short_gamma(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast variance less the squared move, with a hedge that is paid for whenever the move leaves a band."""
    w = W.orderBy("ts")
    v = gentle(spark, sf).groupBy("ts").agg(F.avg("ret").alias("r")).withColumns(
        {"fc": F.sqrt(F.avg(F.col("r") * F.col("r")).over(w.rowsBetween(-24, -1))), "rn": F.row_number().over(w)}
    ).where("rn > 24")
    return v.withColumn("band", F.explode(F.array(F.lit(1.0), F.lit(2.0)))).select(
        "band", "ts", F.expr("fc * fc - r * r").alias("gamma"),
        F.expr("CASE WHEN abs(r) > band * fc THEN -5 / 1e4D ELSE 0.0D END").alias("hedge_cost")
    )


_PREMIUM = f"""{WITH_D}, pv AS (SELECT substring(symbol, 1, 1) AS coin, ts, max(CASE WHEN symbol LIKE '%F' THEN close END) AS f, max(CASE WHEN symbol LIKE '%O' THEN close END) AS o FROM daily GROUP BY 1, 2),
pm AS (SELECT coin, ts, ln(f / o) AS p, ln(o) / 100 AS lo FROM pv WHERE f IS NOT NULL AND o IS NOT NULL), pz AS (SELECT *, CASE WHEN count(p) OVER t >= 15 THEN (p - avg(p) OVER t) / nullif(stddev_samp(p) OVER t, 0) END AS z, lo - lag(lo) OVER (PARTITION BY coin ORDER BY ts) AS ret FROM pm WINDOW t AS (PARTITION BY coin ORDER BY ts ROWS 29 PRECEDING)),
ps AS (SELECT coin, ts, ret, k, coalesce(greatest(-1, least(1, lag(z, CAST(k AS INTEGER)) OVER (PARTITION BY coin, k ORDER BY ts))), 0) AS pos FROM pz, (SELECT unnest([1, 2]) AS k))"""


@query(f"""{_PREMIUM}, tn AS (SELECT *, abs(pos - lag(pos, 1, 0) OVER (PARTITION BY coin, k ORDER BY ts)) AS t FROM ps)
SELECT coin, k, ts, pos, pos * coalesce(ret, 0) - 2 * t * 5 / 1e4 - abs(pos) * 0.1 / 365 AS net FROM tn""", "pos net", "coin k ts")
def venue_premium(spark: SparkSession, sf: str) -> DataFrame:
    """The premium of one venue's price over the other's, scored, clipped and followed a day or two later; legs and borrowing are charged."""
    side = lambda x: F.max(F.when(F.col("symbol").endswith(x), F.col("close")))
    pv = P.daily(spark, sf).groupBy(
        F.substring("symbol", 1, 1).alias("coin"), "ts"
    ).agg(side("F").alias("f"), side("O").alias("o")).where("f IS NOT NULL AND o IS NOT NULL")
    by = W.partitionBy("coin").orderBy("ts")
    t = by.rowsBetween(-29, 0)
    pm = pv.withColumns({"p": F.log(F.col("f") / F.col("o")), "lo": F.log("o") / 100})
    z = pm.withColumns(
        {
            "z": F.when(F.count("p").over(t) >= 15, F.try_divide(F.col("p") - F.avg("p").over(t), F.stddev_samp("p").over(t))),
            "ret": F.col("lo") - F.lag("lo").over(by)
        }
    )
    z = z.withColumns({f"z{k}": F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lag("z", k).over(by))), F.lit(0.0)) for k in (1, 2)})
    ps = z.select("coin", "ts", "ret", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"z{k}").alias("pos")) for k in (1, 2)])))
    t2 = F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(W.partitionBy("coin", "k").orderBy("ts")))
    return ps.withColumn("turn", t2).withColumn("net", F.expr("pos * coalesce(ret, 0.0D) - 2 * turn * 5 / 1e4D - abs(pos) * 0.1D / 365"))


_TERM = f"""{GENTLE}, ct AS (SELECT d.symbol, d.ts, avg((CASE k WHEN 0 THEN close ELSE high END / d.spot - 1) * 365 / greatest(date_diff('day', d.ts, CAST(date_trunc('quarter', d.ts) + to_months(CAST(3 * k + 3 AS INTEGER)) - INTERVAL 1 DAY AS DATE)), 1)) AS ann FROM daily d, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2),
sp AS (SELECT symbol, ts, ann - funding * 1095 AS spread, funding + sret - ret AS unit FROM ct JOIN g USING (symbol, ts)), ls AS (SELECT symbol, list(spread ORDER BY ts) AS v, list(ts ORDER BY ts) AS t FROM sp GROUP BY symbol),
em AS (SELECT symbol, span, t[i] AS ts, list_reduce(v[:i], lambda a, x: 2.0 / (span + 1) * x + (1 - 2.0 / (span + 1)) * a) AS e FROM ls, (SELECT unnest([9, 21, 42]) AS span), unnest(generate_series(1, len(v))) AS q(i)),
el AS (SELECT symbol, span, ts, lag(e) OVER (PARTITION BY symbol, span ORDER BY ts) AS e FROM em),
po AS (SELECT symbol, span, enter, ts, CASE WHEN e IS NULL THEN 0 ELSE coalesce(last_value(CASE WHEN e > enter THEN 1.0 WHEN e < -enter THEN -1.0 WHEN abs(e) < enter / 2 THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY symbol, span, enter ORDER BY ts), 0) END AS pos FROM el, (SELECT unnest([0.2, 0.4, 0.8]) AS enter))"""


@query(f"""{_TERM}, every AS (SELECT symbol || '/' || span || '/' || enter AS name, 365 AS ppy, ts, pos, pos * unit - 2 * abs(pos - lag(pos, 1, 0) OVER (PARTITION BY symbol, span, enter ORDER BY ts)) * 10 / 1e4 AS net, symbol, span, enter FROM po JOIN sp USING (symbol, ts)), nets AS (SELECT *, {_SPLIT} FROM every), {METRICS}, kk AS (SELECT DISTINCT name, symbol, span, enter FROM every)
SELECT symbol, span, enter, split, n, sr_pp, ret_ann, turnover FROM met JOIN kk USING (name)""", "enter sr_pp ret_ann turnover", "symbol span split n")
def term_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Basis against funding under every span and threshold; metrics in and out of sample."""
    g = gentle(spark, sf)
    ann = P.contracts(spark, sf).groupBy("symbol", "ts").agg(F.avg(F.expr("(fut / spot - 1) * 365 / greatest(dte, 1)")).alias("ann"))
    sp = ann.join(g, ["symbol", "ts"]).select(
        "symbol", "ts", F.expr("ann - funding * 1095").alias("spread"), F.expr("funding + sret - ret").alias("unit")
    )
    spans, enters = (9, 21, 42), (0.2, 0.4, 0.8)
    e = T.ewm_grid(sp, ["symbol"], "spread", spans).withColumns({f"e{s}": S.lagged(f"e{s}") for s in spans})
    cells = F.array(*[F.struct(F.lit(s).alias("span"), F.lit(b).alias("enter"), F.col(f"e{s}").alias("e")) for s in spans for b in enters])
    by = W.partitionBy("symbol", "span", "enter").orderBy("ts")
    rows = e.join(sp, ["symbol", "ts"]).select("symbol", "ts", "unit", F.inline(cells)).withColumn(
        "d", F.expr("CASE WHEN e > enter THEN 1.0D WHEN e < -enter THEN -1.0D WHEN abs(e) < enter / 2 THEN 0.0D END")
    )
    rows = rows.withColumn(
        "s", F.coalesce(F.last("d", True).over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))
    ).withColumn("pos", F.expr("CASE WHEN e IS NULL THEN 0.0D ELSE s END"))
    net = rows.withColumn("net", F.col("pos") * F.col("unit") - 2 * F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(by)) * 10 / 1e4)
    return evaluated(net, ["symbol", "span", "enter"], 365)


@query(f"""{RETS}, x AS (SELECT symbol, ts, ret, fwd, count(*) OVER (PARTITION BY ts) AS n, sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 3 PRECEDING) AS m FROM r WHERE ret IS NOT NULL), dm AS (SELECT *, m - avg(m) OVER (PARTITION BY ts) AS d FROM x),
b AS (SELECT symbol, ts, coalesce(fwd, 0) AS fwd, n, sign(m) AS s, CASE WHEN n >= 4 THEN coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY ts), 0), 0) ELSE 0 END AS w FROM dm)
SELECT ts, max(CASE WHEN symbol = 'Brand#1' THEN fwd END) AS lone, avg(fwd) AS basket, sum(s * fwd) / any_value(n) AS momentum, sum(w * fwd) AS predictive FROM b GROUP BY ts""", "lone basket momentum predictive", "ts")
def base_books(spark: SparkSession, sf: str) -> DataFrame:
    """The books that overlays start from: one symbol, all alike, momentum by 1/N, and predictions less their mean."""
    x = _weekly_returns(spark, sf).where("ret IS NOT NULL").withColumns(
        {"m": F.sum("ret").over(S.trailing(4)), "n": F.count("*").over(S.by_time()), "f": F.coalesce("fwd", F.lit(0.0))}
    )
    b = books.demeaned(x, "m")
    return b.groupBy("ts").agg(
        F.max(F.expr("CASE WHEN symbol = 'Brand#1' THEN f END")).alias("lone"), F.avg("f").alias("basket"),
        F.expr("sum(signum(m) * f) / first(n)").alias("momentum"), F.sum(F.col("w") * F.col("f")).alias("predictive")
    )


@query(None)
def low_turnover_carry(spark: SparkSession, sf: str) -> DataFrame:
    """Funding baskets with a rank band, held for the week after, at twenty basis points: metrics in and out of sample."""
    from riverbed.plans.machines import band_baskets

    g = gentle(spark, sf).withColumn("unit", F.expr("funding + sret - ret")).withColumn("week", F.next_day(F.date_sub("ts", 1), "FRI"))
    # what is chosen from one week is held in the next
    chosen = band_baskets(spark, sf).select(F.date_add("ts", 7).alias("week"), "symbol", (-F.col("weight") / 2).alias("w"))
    held = g.join(chosen.groupBy("week", "symbol").agg(F.sum("w").alias("w")), ["week", "symbol"], "left").fillna(0.0, ["w"])
    return evaluated(books.book(held, "unit", 20).select(F.lit("band").alias("name"), "ts", F.col("gross").alias("pos"), "net"), ["name"], 365)


@query(None)
def pairs_by_test(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs with the lowest Dickey-Fuller t in sample, traded by their machine: top three, five and ten."""
    from riverbed.plans.machines import pair_state
    from riverbed.plans.statistics import cointegration

    h = hedged_scores(spark, sf)
    by = W.partitionBy("pair").orderBy("ts")
    unit = h.select("pair", "ts", ((F.col("ya") - F.lag("ya").over(by) - F.col("beta") * (F.col("yb") - F.lag("yb").over(by))) / 100).alias("unit"))
    st = pair_state(spark, sf).select("pair", F.to_date("ts").alias("ts"), F.lag("state", 1, 0).over(by).alias("pos"))
    net = st.join(unit, ["pair", "ts"]).withColumn("turn", F.abs(F.col("pos") - F.lag("pos", 1, 0).over(by))).withColumn(
        "net", F.expr("pos * coalesce(unit, 0.0D) - 2 * turn * 7 / 1e4D")
    )
    ranked = cointegration(spark, sf).where("a < b").select(
        F.concat_ws("/", "a", "b").alias("pair"), F.row_number().over(W.orderBy("t", "a", "b")).alias("place")
    )
    grid = net.join(F.broadcast(ranked), "pair").withColumn("k", F.explode(F.array(*map(F.lit, (3, 5, 10))))).where("place <= k")
    pooled = grid.groupBy("k", "ts").agg(F.avg("net").alias("net"), F.sum(F.abs("pos")).cast("double").alias("pos"))
    return evaluated(pooled, ["k"], 365)


@query(f"""{WITH_B}, h AS (SELECT symbol, ts, volume, dayofweek(ts) AS dow, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM bars)
SELECT dow IN (0, 3) AS settles, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) AS t FROM h GROUP BY 1""", "mean sd t", "settles n")
def settlement_test(spark: SparkSession, sf: str) -> DataFrame:
    """Returns on settlement days against those on others."""
    h = P.bars(spark, sf).select((F.dayofweek("ts") - 1).alias("dow"), F.log(F.col("close") / S.lagged("close")).alias("ret"))
    return h.groupBy(F.col("dow").isin(0, 3).alias("settles")).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd")
    ).withColumn("t", F.expr("mean / (sd / sqrt(n))"))
