"""Grids and refutations of strategies that other modules build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions import series as S
from riverbed.operators import backtest as B
from riverbed.operators import stateful as T
from riverbed.plans.backtests import BATTERY, GENTLE, battery_nets, gentle
from riverbed.plans.books import CARRY, SPANS
from riverbed.plans.machines import _CASCADE, _TIMED, cascades
from riverbed.plans.registry import query


@query(f"""{CARRY}, fr AS (SELECT symbol, span, ts, rank() OVER (PARTITION BY span, ts ORDER BY e) + (count(*) OVER (PARTITION BY span, ts, e) - 1) / 2.0 AS rk FROM el),
fd AS (SELECT *, avg(rk) OVER (PARTITION BY span, ts) - rk AS d FROM fr),
fw AS (SELECT symbol, span, ts, coalesce(d / nullif(sum(abs(d)) OVER (PARTITION BY span, ts), 0), 0) AS w FROM fd),
ft AS (SELECT span, ts, w, ret, abs(w - lag(w, 1, 0) OVER (PARTITION BY symbol, span ORDER BY ts)) AS t FROM fw JOIN g USING (symbol, ts))
SELECT span, ts, sum(w * ret) - sum(t) * 10 / 1e4 AS net, sum(t) AS turnover FROM ft GROUP BY span, ts""", "net turnover", "span ts")
def funding_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    """Long what pays least funding, short what pays most, by rank of smoothed funding as known a day before, for each span."""
    g = gentle(spark, sf)
    e = T.ewm_grid(g, ["symbol"], "funding", SPANS).withColumns({f"e{s}": S.lagged(f"e{s}", 1, 0.0) for s in SPANS})
    cells = F.array(*[F.struct(F.lit(s).alias("span"), F.col(f"e{s}").alias("e")) for s in SPANS])
    rows = e.join(g.select("symbol", "ts", "ret"), ["symbol", "ts"]).select("symbol", "ts", "ret", F.inline(cells))
    day = W.partitionBy("span", "ts")
    rank = F.rank().over(day.orderBy("e")) + (F.count(F.lit(1)).over(W.partitionBy("span", "ts", "e")) - 1) / 2
    d = rows.withColumn("rk", rank).withColumn("d", F.avg("rk").over(day) - F.col("rk"))
    w = d.withColumn("w", F.coalesce(F.try_divide("d", F.sum(F.abs("d")).over(day)), F.lit(0.0)))
    t = w.withColumn("t", F.abs(F.col("w") - F.lag("w", 1, 0.0).over(W.partitionBy("symbol", "span").orderBy("ts"))))
    return t.groupBy("span", "ts").agg((F.sum(F.col("w") * F.col("ret")) - F.sum("t") * 10 / 1e4).alias("net"), F.sum("t").alias("turnover"))


_FOLD = _TIMED.format("abs(s) <= 1 AND", "{k}", "0.0")


def _held(k: int) -> str:
    """Positions of every move size for one holding time, as a fold over each prefix."""
    body = _FOLD.replace("{k}", str(k))
    return f"SELECT symbol, {k} AS k, y, t[i] AS ts, list_reduce(list_prepend(0.0, v[:i]), lambda s, x: {body}) AS s FROM lists, unnest(generate_series(1, len(v))) AS q(i)"


@query(f"""{_CASCADE.replace(" AND abs(ret) >= 0.2", "")}, cy AS (SELECT cs.symbol, cs.ts, y, CASE WHEN abs(ret) >= y THEN x ELSE 0.0 END AS x FROM cs JOIN hr USING (symbol, ts), (SELECT unnest([0.1, 0.2, 0.4]) AS y)),
lists AS (SELECT symbol, y, list(coalesce(x, 0.0) ORDER BY ts) AS v, list(ts ORDER BY ts) AS t FROM cy GROUP BY ALL), st AS ({" UNION ALL ".join(map(_held, (3, 6, 12)))}),
ps AS (SELECT symbol, k, y, ts, lag(sign(s), 1, 0) OVER w AS p, lag(sign(s), 2, 0) OVER w AS p0 FROM st WINDOW w AS (PARTITION BY symbol, k, y ORDER BY ts))
SELECT k, y, count(*) FILTER (p <> 0 AND p0 = 0) AS events, sum(p * coalesce(ret, 0) - abs(p - p0) * 5 / 1e4) AS net, count(*) FILTER (p <> 0 AND p0 = 0) >= 8 AS enough FROM ps JOIN hr USING (symbol, ts) GROUP BY k, y""", "y net", "k events enough")
def cascade_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Events and net of fading cascades for every size of move and time held; fewer than eight events don't count."""
    base = cascades(spark, sf, least_move=0.0)
    sizes = base.withColumn("y", F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.4))))).withColumn(
        "x", F.expr("CASE WHEN abs(ret) >= y THEN x ELSE 0.0D END")
    )
    every = None
    for k in (3, 6, 12):
        st = T.timed_position(sizes.fillna(0.0, ["x"]), ["symbol", "y"], "x", k, False).withColumn("k", F.lit(k))
        every = st if every is None else every.unionByName(st)
    by = W.partitionBy("symbol", "k", "y").orderBy("ts")
    p = every.withColumns(
        {"p": F.lag("state", 1, 0).over(by), "p0": F.lag("state", 2, 0).over(by)}
    ).join(base.select("symbol", "ts", "ret"), ["symbol", "ts"])
    out = p.groupBy("k", "y").agg(
        F.count_if(F.expr("p <> 0 AND p0 = 0")).alias("events"), F.sum(F.expr("p * coalesce(ret, 0.0D) - abs(p - p0) * 5 / 1e4D")).alias("net")
    )
    return out.withColumn("enough", F.col("events") >= 8)


@query(f"""{GENTLE}, pr AS (SELECT a.symbol AS lead, b.symbol AS follow, a.ts, a.ret AS x, b.ret AS y FROM g a JOIN g b ON a.ts = b.ts AND a.symbol <> b.symbol),
lg AS (SELECT *, lag(x) OVER w AS x1, row_number() OVER w <= floor(count(*) OVER (PARTITION BY lead, follow) * 0.6) AS ins FROM pr WINDOW w AS (PARTITION BY lead, follow ORDER BY ts)),
co AS (SELECT lead, follow, corr(x1, y) AS rho FROM lg WHERE ins GROUP BY 1, 2),
po AS (SELECT lead, follow, ts, y, CASE WHEN abs(rho) >= 0.05 THEN coalesce(sign(rho) * sign(x1), 0) ELSE 0 END AS pos FROM lg JOIN co USING (lead, follow) WHERE NOT ins),
tn AS (SELECT *, abs(pos - lag(pos, 1, 0) OVER (PARTITION BY lead, follow ORDER BY ts)) AS t FROM po)
SELECT lead, follow, count(*) AS n, sum(pos * y) AS gross, sum(pos * y - t * 10 / 1e4) AS net, avg(t) AS turnover FROM tn GROUP BY 1, 2""", "gross net turnover", "lead follow n")
def lead_lag_trades(spark: SparkSession, sf: str) -> DataFrame:
    """What following each symbol's last move in another earns after the cut, in the direction that held before it."""
    g = gentle(spark, sf)
    pr = g.select("ts", F.col("symbol").alias("lead"), F.col("ret").alias("x")).join(
        g.select("ts", F.col("symbol").alias("follow"), F.col("ret").alias("y")), "ts"
    )
    keys = ["lead", "follow"]
    by = W.partitionBy(*keys).orderBy("ts")
    lg = B.split(pr.where("lead <> follow").withColumn("x1", F.lag("x").over(by)), keys)
    rho = lg.where("split = 'is'").groupBy(*keys).agg(F.corr("x1", "y").alias("rho"))
    po = lg.where("split = 'oos'").join(rho, keys).withColumn(
        "pos", F.expr("CASE WHEN abs(rho) >= 0.05 THEN coalesce(signum(rho) * signum(x1), 0.0D) ELSE 0.0D END")
    )
    t = po.withColumn("t", F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(by)))
    return t.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.expr("pos * y")).alias("gross"), F.sum(F.expr("pos * y - t * 10 / 1e4D")).alias("net"),
        F.avg("t").alias("turnover")
    )


@query(f"""{BATTERY}, rk AS (SELECT name, ts, net, pos, lag(pos, 1, 0) OVER (PARTITION BY name ORDER BY ts) AS was, row_number() OVER (PARTITION BY name ORDER BY net DESC, ts) AS place FROM nets WHERE split = 'oos'),
ag AS (SELECT name, count(*) AS n, sum(net) AS total, sum(CASE WHEN place <= 5 THEN net END) AS best5, min(net) AS worst, count(*) FILTER (pos <> 0 AND was = 0) AS episodes FROM rk GROUP BY name)
SELECT name, n, total, best5, worst, episodes, total > 0 AND total - best5 <= 0 AS carried_by_five FROM ag""", "total best5 worst", "name n episodes carried_by_five")
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each variant's result after the cut comes from five days, and from how many episodes."""
    by = W.partitionBy("name")
    o = B.split(battery_nets(spark, sf), ["name"]).where("split = 'oos'")
    r = o.withColumns({"was": F.lag("pos", 1, 0.0).over(by.orderBy("ts")), "place": F.row_number().over(by.orderBy(F.desc("net"), "ts"))})
    a = r.groupBy("name").agg(
        F.count("*").alias("n"), F.sum("net").alias("total"), F.sum(F.when(F.col("place") <= 5, F.col("net"))).alias("best5"), F.min("net").alias("worst"),
        F.count_if(F.expr("pos <> 0 AND was = 0")).alias("episodes")
    )
    return a.withColumn("carried_by_five", F.expr("total > 0 AND total - best5 <= 0"))
