"""Window functionals of each symbol and of whole panels, and the books and gates that follow them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions import kernels as K
from riverbed.functions import series as S
from riverbed.operators import backtest as B
from riverbed.operators import books, fits, validation
from riverbed.operators import stateful as T
from riverbed.operators.functional import per_panel, per_series, windows
from riverbed.plans.backtests import evaluated, gentle
from riverbed.plans.panel_ops import features
from riverbed.plans.registry import query
from riverbed.plans.research import DRETS, RETS, _daily_returns, _weekly_returns
from riverbed.sources import panels as P
from riverbed.sources.cache import kept


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return _daily_returns(spark, sf).where("ret IS NOT NULL").select("symbol", "ts", "ret")


# ---- one series


@query(None)
def series_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Of each symbol's returns: sample entropy of the last 300, multifractal width, tail shape of losses, and recurrence of the last 200."""

    def all_(x: np.ndarray) -> tuple:
        rr, det, lam, tt = K.recurrence(x[-200:])
        return K.sample_entropy(x[-300:]), K.multifractal_width(x), K.pareto_shape(-x), K.hill(-x, 20), rr, det, lam, tt

    out = "sample_entropy double, width double, pareto_shape double, hill double, rate double, determinism double, laminarity double, trapping double"
    return per_series(_returns(spark, sf), ["symbol"], ["ret"], all_, out)


@query(None)
def rolling_functionals(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy, tail index, multifractal width, determinism and the signature's area over the last 120 days, renewed every twenty: each from the past alone."""

    def all_(x: np.ndarray) -> tuple:
        area = K.signature(K.path_channels(x), 2)
        return K.permutation_entropy(x, 4), K.hill(-x, 10), K.multifractal_width(x), K.recurrence(x)[1], float(area[3] - area[4])

    out = "entropy double, hill double, width double, determinism double, area double"
    return T.rolling_apply(_returns(spark, sf), ["symbol"], ["ret"], 120, 20, all_, out)


_OP = "(CASE WHEN {0} <= {1} THEN 1 ELSE 0 END)"


@query(f"""{DRETS}, x AS (SELECT symbol, ts, ret AS c, lag(ret) OVER w AS b, lag(ret, 2) OVER w AS a FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
p AS (SELECT symbol, ts, CASE WHEN a IS NOT NULL THEN {_OP.format("a", "b")} * 4 + {_OP.format("a", "c")} * 2 + {_OP.format("b", "c")} END AS k FROM x),
n AS (SELECT symbol, ts, count(k) OVER w AS n, {", ".join(f"count(*) FILTER (k = {k}) OVER w AS n{k}" for k in range(8))} FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 57 PRECEDING))
SELECT symbol, ts, CASE WHEN n >= 58 THEN -({" + ".join(f"CASE WHEN n{k} > 0 THEN n{k} * 1.0 / n * ln(n{k} * 1.0 / n) ELSE 0 END" for k in range(8))}) / ln(6) END AS entropy FROM n""", "entropy", "symbol ts")
def rolling_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of order patterns of three over 58 of them, by counts in a window."""
    x = _returns(spark, sf).select("symbol", "ts", F.col("ret").alias("c"), S.lagged("ret").alias("b"), S.lagged("ret", 2).alias("a"))
    p = x.withColumn("k", F.expr("CASE WHEN a IS NOT NULL THEN int(a <= b) * 4 + int(a <= c) * 2 + int(b <= c) END"))
    w = S.trailing(58)
    n = p.select("symbol", "ts", F.count("k").over(w).alias("n"), *[F.count_if(F.col("k") == k).over(w).alias(f"n{k}") for k in range(8)])
    share = " + ".join(f"CASE WHEN n{k} > 0 THEN n{k} * 1.0D / n * ln(n{k} * 1.0D / n) ELSE 0.0D END" for k in range(8))
    return n.select("symbol", "ts", F.expr(f"CASE WHEN n >= 58 THEN -({share}) / ln(6) END").alias("entropy"))


@query(f"""{DRETS}, l AS (SELECT symbol, ts, list(ret) OVER w AS v, count(*) OVER w AS n FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 119 PRECEDING)),
s AS (SELECT symbol, ts, list_reverse_sort([-y FOR y IN v IF y < 0]) AS x FROM l WHERE n >= 120)
SELECT symbol, ts, CASE WHEN len(x) >= 12 THEN 1 / (list_avg([ln(y) FOR y IN x[1:10]]) - ln(x[11])) END AS hill FROM s""", "hill", "symbol ts")
def rolling_hill(spark: SparkSession, sf: str) -> DataFrame:
    """Tail index of the ten largest losses of the last 120 days: the window holds a bounded list."""
    w = S.trailing(120)
    s = _returns(spark, sf).select("symbol", "ts", F.collect_list("ret").over(w).alias("v"), F.count("*").over(w).alias("n")).where("n >= 120")
    s = s.withColumn("x", F.expr("sort_array(transform(filter(v, y -> y < 0), y -> -y), false)"))
    mean = "aggregate(transform(slice(x, 1, 10), y -> ln(y)), 0.0D, (a, y) -> a + y) / 10"
    return s.select("symbol", "ts", F.expr(f"CASE WHEN size(x) >= 12 THEN 1 / ({mean} - ln(x[10])) END").alias("hill"))


@query(f"""{DRETS}, q AS (SELECT symbol, quantile_cont(-ret, 0.9) AS u, count(*) AS n FROM r WHERE ret < 0 GROUP BY symbol HAVING count(*) >= 30),
y AS (SELECT symbol, -ret - u AS y FROM r JOIN q USING (symbol) WHERE ret < 0 AND -ret > u), k AS (SELECT symbol, y, row_number() OVER (PARTITION BY symbol ORDER BY y) AS i, count(*) OVER (PARTITION BY symbol) AS m FROM y),
a AS (SELECT symbol, any_value(m) AS m, avg(y) AS a0, avg((1 - (i - 0.35) / m) * y) AS a1 FROM k GROUP BY symbol HAVING any_value(m) >= 10)
SELECT symbol, m, 2 - a0 / (a0 - 2 * a1) AS shape FROM a""", "shape", "symbol m")
def tail_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Shape of a generalised Pareto tail above the ninth tenth of losses, by weighted moments."""
    x = _returns(spark, sf).where("ret < 0").withColumn("loss", -F.col("ret"))
    q = x.groupBy("symbol").agg(F.percentile("loss", F.lit(0.9)).alias("u"), F.count("*").alias("n")).where("n >= 30")
    y = x.join(q, "symbol").where("loss > u").withColumn("y", F.expr("loss - u"))
    k = y.withColumns({"i": F.row_number().over(W.partitionBy("symbol").orderBy("y")), "m": F.count("*").over(W.partitionBy("symbol"))})
    a = k.groupBy("symbol").agg(
        F.first("m").alias("m"), F.avg("y").alias("a0"), F.avg(F.expr("(1 - (i - 0.35D) / m) * y")).alias("a1")
    ).where("m >= 10")
    return a.withColumn("shape", F.expr("2 - a0 / (a0 - 2 * a1)"))


@query(f"""{DRETS}, x AS (SELECT symbol, ts, ret, sum(ret) OVER c AS level, row_number() OVER c AS n FROM r WHERE ret IS NOT NULL WINDOW c AS (PARTITION BY symbol ORDER BY ts)),
w AS (SELECT symbol, ts, n, sum(ret) OVER t AS s1, sum(ret * level) OVER t AS rl, first_value(level - ret) OVER t AS base, sum(ret * ret) OVER t AS r2 FROM x WINDOW t AS (PARTITION BY symbol ORDER BY ts ROWS 15 PRECEDING))
SELECT symbol, ts, s1 AS first_level, rl - base * s1 - r2 / 2 AS second_level FROM w WHERE n >= 16""", "first_level second_level", "symbol ts")
def signature_sums(spark: SparkSession, sf: str) -> DataFrame:
    """The first two levels of the signature of a path of 16 steps by sums in a window: the second is half the square of the first."""
    c = S.by_symbol().rowsBetween(W.unboundedPreceding, 0)
    x = _returns(spark, sf).withColumns({"level": F.sum("ret").over(c), "n": F.row_number().over(S.by_symbol())})
    t = S.trailing(16)
    w = x.select(
        "symbol", "ts", "n", F.sum("ret").over(t).alias("s1"), F.sum(F.col("ret") * F.col("level")).over(t).alias("rl"),
        F.first(F.col("level") - F.col("ret")).over(t).alias("base"), F.sum(F.col("ret") * F.col("ret")).over(t).alias("r2")
    )
    return w.where("n >= 16").select("symbol", "ts", F.col("s1").alias("first_level"), F.expr("rl - base * s1 - r2 / 2").alias("second_level"))


@query(None)
def path_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures up to the third level of time, return and order flow over 24 days, renewed every eight."""
    f = features(spark, sf).where("raw_ret IS NOT NULL AND ofi IS NOT NULL").select("symbol", "ts", "raw_ret", "ofi")
    names = ", ".join(f"s{k} double" for k in range(39))
    return T.rolling_apply(f, ["symbol"], ["raw_ret", "ofi"], 24, 8, lambda a, b: tuple(K.signature(K.path_channels(a, b), 3)), names)


@query(None)
def signature_models(spark: SparkSession, sf: str) -> DataFrame:
    """Tomorrow's return and its sign from two levels of the signature, fitted on the first part: coefficients by sums, metrics of both books afterwards."""
    sig = T.rolling_apply(
        _returns(spark, sf), ["symbol"], ["ret"], 16, 1, lambda x: tuple(K.signature(K.path_channels(x), 2)),
        ", ".join(f"s{k} double" for k in range(6))
    )
    g = gentle(spark, sf).select("symbol", "ts", "ret").withColumn("fwd", F.coalesce(F.lead("ret").over(S.by_symbol()), F.lit(0.0)))
    cols = [f"s{k}" for k in range(6)]
    j = kept(B.split(sig.join(g, ["symbol", "ts"]).dropna(subset=cols), ["symbol"]))
    train = j.where("split = 'is'").withColumn("up", (F.col("fwd") > 0).cast("double"))
    line, odds = fits.ridge(train, cols, "fwd", 10.0), fits.logistic(train, cols, "up", 1.0)
    p = j.withColumns({"ridge": F.signum(fits.linear(cols, line)), "logit": 1 / (1 + F.exp(-fits.linear(cols, odds))) - 0.5})
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.signum(a).alias("pos")) for a in ("ridge", "logit")])
    rows = p.select("symbol", "ts", "fwd", F.inline(arms))
    turn = F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(W.partitionBy("symbol", "arm").orderBy("ts")))
    return evaluated(rows.withColumn("net", F.col("pos") * F.col("fwd") - turn * 5 / 1e4), ["symbol", "arm"], 365)


@query(None)
def self_excitation(spark: SparkSession, sf: str) -> DataFrame:
    """Events are days that move more than 1.5 deviations of the 90 before; of those in the last 120 days, renewed every thirty, a self-exciting process: branching ratio and rate over base rate."""
    before = S.by_symbol().rowsBetween(-90, -1)
    e = _returns(spark, sf).withColumn(
        "event", F.when(F.count("ret").over(before) >= 45, (F.abs("ret") > 1.5 * F.stddev_samp("ret").over(before)).cast("double")).otherwise(0.0)
    )

    def fit(x: np.ndarray) -> tuple:
        n, ratio, base = K.hawkes(np.flatnonzero(x).astype(float), float(len(x)))
        return float(x.sum()), n, ratio, base

    return T.rolling_apply(e, ["symbol"], ["event"], 120, 30, fit, "events double, branching double, ratio double, base double")


@query(None)
def embedded_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the delay embedding (three values) of the market's return over forty days, renewed every ten: merge lengths, their norms, and proxies of loops. One series."""
    m = _returns(spark, sf).groupBy("ts").agg(F.avg("ret").alias("ret")).withColumn("symbol", F.lit("market"))
    names = "total double, norm double, longest double, landscape1 double, landscape2 double, gap double, nearest double"
    return T.rolling_apply(m, ["symbol"], ["ret"], 40, 10, lambda x: K.shape_features(K.standardized(K.embedded(x, 3, 1))), names)


# ---- whole panels


def _filled(panel: DataFrame) -> DataFrame:
    """symbol, ts, ret on all dates and symbols from the first date on which all have a price; nothing moved where nothing was traded."""
    d = P.dense(panel.select("symbol", "ts", "close"), ["close"]).withColumn("ret", S.simple_return("close")).where("ret IS NOT NULL")
    return d.select("symbol", "ts", "ret")


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(P.weekly_universe(spark, sf))


@query(None)
def cloud_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The same features of the cloud of forty weeks of all symbols' returns, every ten weeks: a window of the panel is one group."""
    names = "total double, norm double, longest double, landscape1 double, landscape2 double, gap double, nearest double"
    return per_panel(windows(_wide(spark, sf), [], 40, 10), ["win"], "symbol", "ret", lambda n, x, t: [K.shape_features(K.standardized(x))], names)


@query(None)
def residual_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every ten weeks, from the sixty before: factors above the noise edge, what they leave of each symbol, and how far its running sum is from its mean."""

    def each(names: list, x: np.ndarray, times: list) -> list[tuple]:
        if len(x) < 40 or len(names) < 3:
            return []
        scores, k = K.residual_scores(x)
        return [(n, *s, k) for n, s in zip(names, scores, strict=True)]

    return per_panel(
        windows(_wide(spark, sf), [], 60, 10), ["win"], "symbol", "ret", each, "symbol string, s double, kappa double, half_life double, factors int"
    )


@query(None)
def residual_book(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of residual scores from one window to the next, those that revert too slowly flat, demeaned to gross one, and what they earn over the next weeks: metrics."""
    s = residual_scores(spark, sf).withColumnRenamed("win", "ts").withColumn("ok", F.col("kappa") > 8)
    st = T.score_book(s, ["symbol"])
    dm = st.withColumn("d", F.col("state") - F.avg("state").over(S.by_time())).withColumn(
        "w", F.coalesce(F.try_divide("d", F.sum(F.abs("d")).over(S.by_time())), F.lit(0.0))
    )
    # the weight set at a window's end is held until the next
    ends = dm.select("symbol", F.col("ts").alias("from_"), F.lead("ts").over(S.by_symbol()).alias("to_"), "w")
    r = _wide(spark, sf)
    held = r.join(F.broadcast(ends), "symbol").where("ts > from_ AND (to_ IS NULL OR ts <= to_)").select(
        "symbol", "ts", (F.col("ret") / 10).alias("ret"), "w"
    )
    return evaluated(books.book(held, "ret", 5).select(F.lit("residual").alias("name"), "ts", F.col("gross").alias("pos"), "net"), ["name"], 52)


BINS, SHUFFLES = 3, 20


@query(None)
def information_flow(spark: SparkSession, sf: str) -> DataFrame:
    """For each ordered pair of daily symbols and lags of one to three days: transfer entropy in three bins, and its distance from circular shifts. A pair is one group."""
    r = _returns(spark, sf)
    pairs = r.withColumnsRenamed({"symbol": "lead", "ret": "x"}).join(
        r.withColumnsRenamed({"symbol": "follow", "ret": "y"}), "ts"
    ).where("lead <> follow")

    def all_(x: np.ndarray, y: np.ndarray) -> tuple:
        if len(x) < 40:
            return (K.NAN,) * 6
        a, b = K.binned(x, BINS), K.binned(y, BINS)
        out = [K.transfer_score(a, b, lag, BINS, SHUFFLES, lag) for lag in (1, 2, 3)]
        return tuple(v for pair in out for v in pair)

    return per_series(pairs, ["lead", "follow"], ["x", "y"], all_, ", ".join(f"te{k} double, z{k} double" for k in (1, 2, 3)))


def _network(names: list, x: np.ndarray, times: list) -> list[tuple]:
    if len(x) < 40:
        return []
    d, rows = [K.binned(x[:, k], BINS) for k in range(len(names))], []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i != j:
                te, z = K.transfer_score(d[i], d[j], 1, BINS, 10, 7)
                rows.append((a, b, te, z))
    return rows


def flow_network(spark: SparkSession, sf: str) -> DataFrame:
    """win, src, dst, te, z: edges of the network over 200 days, refitted every 100: one group a refit, over a handful of symbols."""
    made = per_panel(
        windows(_filled(P.daily(spark, sf)), [], 200, 100), ["win"], "symbol", "ret", _network, "src string, dst string, te double, z double"
    )
    return kept(made)


@query(None)
def flow_centrality(spark: SparkSession, sf: str, edges: DataFrame | None = None) -> DataFrame:
    """Of each refit: what flows out of a symbol and into it over edges that stand out, the difference, and the network's density."""
    e = (edges or flow_network(spark, sf)).withColumn("sig", F.expr("CASE WHEN z >= 1 THEN te ELSE 0.0D END"))
    ends = e.select(
        "win", "sig",
        F.inline(
            F.array(F.struct(F.col("src").alias("symbol"), F.lit(1).alias("side")), F.struct(F.col("dst").alias("symbol"), F.lit(-1).alias("side")))
        )
    )
    c = ends.groupBy("win", "symbol").agg(
        F.sum(F.expr("CASE WHEN side = 1 THEN sig ELSE 0.0D END")).alias("outflow"),
        F.sum(F.expr("CASE WHEN side = -1 THEN sig ELSE 0.0D END")).alias("inflow")
    )
    density = e.groupBy("win").agg(F.avg(F.expr("CASE WHEN sig > 0 THEN 1.0D ELSE 0.0D END")).alias("density"), F.sum("sig").alias("coupling"))
    return c.join(F.broadcast(density), "win").withColumn("net_out", F.expr("outflow - inflow"))


@query(None)
def page_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of each symbol in each refit's network by eight rounds of its edges' shares: joins of edges, no matrix."""
    e = flow_network(spark, sf)
    out = e.where("z >= 1 AND te > 0").withColumn("share", F.col("te") / F.sum("te").over(W.partitionBy("win", "src")))
    nodes = e.select("win", F.col("src").alias("symbol")).distinct()
    n = F.count("*").over(W.partitionBy("win"))
    rank = nodes.withColumn("n", n).withColumn("rank", 1 / F.col("n"))
    for _ in range(8):
        flow = out.join(
            rank.select("win", F.col("symbol").alias("src"), "rank"), ["win", "src"]
        ).groupBy("win", F.col("dst").alias("symbol")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        rank = rank.drop("rank").join(flow, ["win", "symbol"], "left").withColumn(
            "rank", 0.15 / F.col("n") + 0.85 * F.coalesce("got", F.lit(0.0))
        ).drop("got")
    return rank.select("win", "symbol", "rank")


@query(None)
def sink_follow(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols into which most flows, followed by what those that lead them did the day before: demeaned to gross one, metrics."""
    network = flow_network(spark, sf)
    e = network.withColumn("sig", F.expr("CASE WHEN z >= 1 THEN te ELSE 0.0D END"))
    c = flow_centrality(spark, sf, network).withColumn(
        "place", F.row_number().over(W.partitionBy("win").orderBy("net_out", "symbol"))
    ).where("place <= 3").select("win", F.col("symbol").alias("dst"))
    led = e.join(c, ["win", "dst"])
    spans = e.select("win").distinct().withColumn("until", F.lead("win").over(W.orderBy("win")))
    g = gentle(spark, sf).select("symbol", "ts", "ret")
    day = g.join(F.broadcast(spans), F.expr("ts > win AND (until IS NULL OR ts <= until)"))
    signal = led.join(
        day.select("win", F.col("symbol").alias("src"), "ts", "ret"), ["win", "src"]
    ).groupBy("win", F.col("dst").alias("symbol"), "ts").agg(F.sum(F.col("sig") * F.col("ret")).alias("pull"))
    j = day.join(signal, ["win", "symbol", "ts"], "left").withColumn("s", F.lag(F.coalesce(F.signum("pull"), F.lit(0.0)), 1, 0.0).over(S.by_symbol()))
    b = books.book(books.demeaned(j, "s", 2), "ret", 5)
    return evaluated(b.select(F.lit("sink").alias("name"), "ts", F.col("gross").alias("pos"), "net"), ["name"], 365)


# ---- gates


_GATES = ("entropy", "hill", "width", "determinism", "area")


@query(None)
def functional_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Every rolling functional as a gate on a plain position, its threshold from the first part, against no gate and against a gate on volatility: verdicts by symbol and functional."""
    f = rolling_functionals(spark, sf)
    g = gentle(spark, sf).select("symbol", "ts", "ret").withColumn("vol", F.stddev_samp("ret").over(S.trailing(10)))
    j = validation.gates(kept(B.split(g.join(f, ["symbol", "ts"]), ["symbol"])), [*_GATES, "vol"], 0.7)
    arms = F.array(
        F.struct(F.lit("base").alias("arm"), F.lit(1.0).alias("pos")),
        *[F.struct(F.lit(c).alias("arm"), F.col(f"by_{c}").alias("pos")) for c in (*_GATES, "vol")]
    )
    rows = j.select("symbol", "ts", "ret", F.inline(arms))
    turn = F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(W.partitionBy("symbol", "arm").orderBy("ts")))
    m = kept(evaluated(rows.withColumn("net", F.col("pos") * F.col("ret") - turn * 5 / 1e4), ["symbol", "arm"], 365).where("split = 'oos'"))
    out = [validation.overlay_verdict(m, ["symbol"], "arm", "base", c, "vol", 0.1).withColumn("gauge", F.lit(c)) for c in _GATES]
    for o in out[1:]:
        out[0] = out[0].unionByName(o)
    return out[0]


@query(f"""{DRETS}, z AS (SELECT symbol, ts, ret, close, CASE WHEN count(close) OVER w >= 15 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS z FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING))
SELECT symbol, ts, coalesce(z, 0) AS z0, lag(z) OVER (PARTITION BY symbol ORDER BY ts) AS z1, z - lag(z, 3) OVER (PARTITION BY symbol ORDER BY ts) AS dz FROM z""", "z0 z1 dz", "symbol ts")
def causal_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score of the last thirty days under its fill rules: zero, a day late, and its change."""
    z = _daily_returns(spark, sf).select("symbol", "ts", S.zscore("close", 30, 15).alias("z"))
    return z.select("symbol", "ts", F.coalesce("z", F.lit(0.0)).alias("z0"), S.lagged("z").alias("z1"), (F.col("z") - S.lagged("z", 3)).alias("dz"))


@query(None)
def differenced_models(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of fractionally differenced prices over 12, 30 and 60 days predict tomorrow by a ridge fitted on the first part; the residual reverts: both books, metrics."""
    w = K.frac_weights(0.4, 0.01)
    level = F.log(F.col("px"))
    g = gentle(spark, sf).withColumn("fd", sum((F.lit(float(x)) * F.lag(level, k).over(S.by_symbol()) for k, x in enumerate(w)), F.lit(0.0)))
    g = g.withColumns({f"z{n}": S.zscore("fd", n, n // 2) for n in (12, 30, 60)}).withColumn(
        "fwd", F.coalesce(F.lead("ret").over(S.by_symbol()), F.lit(0.0))
    )
    cols = ["z12", "z30", "z60"]
    j = B.split(g.dropna(subset=cols), ["symbol"])
    line = fits.ridge(j.where("split = 'is'"), cols, "fwd", 10.0)
    p = j.withColumns({"predict": fits.linear(cols, line), "revert": -F.col("z30")})
    out = None
    for arm in ("predict", "revert"):
        b = books.book(books.demeaned(p, arm, 2), "fwd", 5).select(F.lit(arm).alias("name"), "ts", F.col("gross").alias("pos"), "net")
        out = b if out is None else out.unionByName(b)
    return evaluated(out, ["name"], 365)


@query(f"""{RETS}, m AS (SELECT ts, avg(ret) AS ret FROM r WHERE ret IS NOT NULL GROUP BY ts), e AS (SELECT ts, ret, avg(ret) OVER w AS mu, stddev_pop(ret) OVER w AS sd, list(ret) OVER w AS a, list(ret) OVER p AS b FROM m WINDOW w AS (ORDER BY ts ROWS 19 PRECEDING), p AS (ORDER BY ts ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)),
d AS (SELECT ts, ret, list_sum([abs(x[1] - x[2]) FOR x IN list_zip(list_sort(a), list_sort(b))]) / 20 AS w1 FROM e WHERE len(b) = 20)
SELECT ts, lag(w1) OVER (ORDER BY ts) AS w1, ret, CASE WHEN lag(w1) OVER (ORDER BY ts) > quantile_cont(w1, 0.7) OVER (ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) THEN 0.0 ELSE 1.0 END AS gate FROM d""", "w1 ret gate", "ts")
def transport_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of the market's last twenty weeks from the twenty before, a week late, and a gate on its own past. One row a week."""
    w = W.orderBy("ts")
    m = _weekly_returns(spark, sf).where("ret IS NOT NULL").groupBy("ts").agg(F.avg("ret").alias("ret"))
    e = m.select(
        "ts", "ret", F.collect_list("ret").over(w.rowsBetween(-19, 0)).alias("a"), F.collect_list("ret").over(w.rowsBetween(-39, -20)).alias("b")
    ).where("size(b) = 20")
    d = e.select(
        "ts", "ret", F.expr("aggregate(zip_with(array_sort(a), array_sort(b), (x, y) -> abs(x - y)), 0.0D, (s, x) -> s + x) / 20").alias("w1")
    )
    d = d.withColumns({"late": F.lag("w1").over(w), "q": F.percentile("w1", F.lit(0.7)).over(w.rowsBetween(-60, -1))})
    return d.select("ts", F.col("late").alias("w1"), "ret", F.expr("CASE WHEN late > q THEN 0.0D ELSE 1.0D END").alias("gate"))
