"""Operators that have no SQL, against plain Python on small tables; causality; sources, sinks, streams and the paper book."""

import datetime as dt
import io
import json
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riverbed.functions import kernels as K
from riverbed.functions import names as N
from riverbed.functions.probability import benchmark, deflated_benchmark, normal_cdf, upper_quantile
from riverbed.live import book as L
from riverbed.operators import backtest, books, fits, formulas, joins, search
from riverbed.operators import functional as Fn
from riverbed.operators import stateful as T
from riverbed.sinks import files
from riverbed.sources import cache, payloads
from riverbed.streaming import bars

DAY = dt.date(2024, 1, 1)


def series(spark, values, symbols=("a",), cols="x double"):
    """Rows of each symbol, a day apart; a symbol's values are turned by its place."""
    rows = []
    for k, s in enumerate(symbols):
        for t, v in enumerate(values):
            v = v if isinstance(v, tuple) else (v,)
            rows.append((s, DAY + dt.timedelta(days=t), *(None if x is None else float(x) * (1 if k % 2 == 0 else -1) for x in v)))
    return spark.createDataFrame(rows, f"symbol string, ts date, {cols}")


def column(df, name, symbol="a"):
    return [r[name] for r in df.where(F.col("symbol") == symbol).orderBy("ts").collect()]


def test_scan_goes_on_across_batches_and_keys(spark):
    n = 25_000  # more than one Arrow batch
    df = spark.range(n).select(
        F.expr("IF(id % 3 = 0, 'a', IF(id % 3 = 1, 'b', NULL))").alias("symbol"), F.col("id").alias("ts"), F.lit(1.0).alias("x")
    )
    got = T.scan(df, ["symbol"], ["ts"], ["x"], lambda: 0.0, lambda s, r: (s + r[0], (s + r[0],)), "total double")
    ends = {r["symbol"]: (r["m"], r["n"]) for r in got.groupBy("symbol").agg(F.max("total").alias("m"), F.count("*").alias("n")).collect()}
    assert all(m == k for m, k in ends.values()) and sum(k for _, k in ends.values()) == n and set(ends) == {"a", "b", None}
    assert T.scan(df.limit(0), ["symbol"], ["ts"], ["x"], lambda: 0.0, lambda s, r: (s, (s,)), "total double").count() == 0


def test_exponential_means_equal_pandas(spark):
    x = np.random.default_rng(0).normal(size=300)
    df = series(spark, x, ("a", "b"))
    want = pd.Series(x).ewm(span=9, adjust=False).mean()
    assert column(T.ewm(df, ["symbol"], "x", 9), "ema") == pytest.approx(want)
    grid = T.ewm_grid(df, ["symbol"], "x", (3, 9))
    assert column(grid, "e9", "b") == pytest.approx(-want) and column(grid, "e3") == pytest.approx(pd.Series(x).ewm(span=3, adjust=False).mean())
    gap = series(spark, [1, None, 3])
    assert column(T.ewm(gap, ["symbol"], "x", 3), "ema") == [1, 1, 2]


def test_machines_on_hand_made_rows(spark):
    z = series(spark, [0, 2.5, 1, 0.4, -3, None, -0.6, 3, -0.4, 0])
    assert column(T.pair_position(z, ["symbol"], "x"), "state") == [0, -1, -1, 0, 1, 1, 1, 0, 0, 0]
    s = series(spark, [0, 1, 0, -1, 0, 0, 0, -1, 0])
    assert column(T.timed_position(s, ["symbol"], "x", 3, False), "state") == [0, 1, 1, 1, 0, 0, 0, -1, -1]
    assert column(T.timed_position(s, ["symbol"], "x", 3, True), "state") == [0, 1, 1, -1, -1, -1, 0, -1, -1]
    score = series(spark, [(-2, 1), (-1, 1), (-0.4, 1), (2, 1), (1, 0), (None, 1)], cols="s double, k double").withColumn("ok", F.col("k") > 0)
    assert column(T.score_book(score, ["symbol"]), "state") == [1, 1, 0, -1, 0, 0]
    lists = spark.createDataFrame(
        [("l", 1, ["a", "b", "c"]), ("l", 2, ["c", "b", "a"]), ("l", 3, ["c", "d", "b", "a"]), ("l", 4, ["d"])],
        "side string, ts int, names array<string>"
    )
    got = [r["members"] for r in T.band_basket(lists, ["side"], 2, 1).orderBy("ts").collect()]
    assert got == [["a", "b"], ["a", "b"], ["b", "c"], ["d"]]


def test_kalman_hedge_equals_matrices(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=80).cumsum()
    y = 2 * x + 1 + 0.1 * rng.normal(size=80)
    got = T.kalman_hedge(series(spark, list(zip(x, y, strict=True)), cols="x double, y double"), ["symbol"], "x", "y").orderBy("ts").collect()
    state, p = np.zeros(2), np.eye(2)
    for r, u, v in zip(got, x, y, strict=True):
        p = p + np.eye(2) * 1e-4 / (1 - 1e-4)
        h = np.array([u, 1.0])
        e, s = v - h @ state, h @ p @ h + 1e-3
        k = p @ h / s
        state, p = state + k * e, p - np.outer(k, h @ p)
        assert (r["beta"], r["alpha"], r["resid"]) == pytest.approx((*state, e))
    assert state[0] == pytest.approx(2, abs=0.2)


def test_market_maker_equals_loop(spark):
    rng = np.random.default_rng(0)
    mid = 100 + rng.normal(size=60).cumsum()
    rows = [(m, None if i == 59 else mid[i + 1], *rng.exponential(5, 2), rng.normal()) for i, m in enumerate(mid)]
    df = series(spark, rows, cols="mid double, next_mid double, sell_agg double, buy_agg double, z double")
    got = T.market_maker(df, ["symbol"], 1.0, 0.5, -0.5, 0.1, 1.0).orderBy("ts").collect()
    inv = 0.0
    for r, (m, nxt, sell, buy, z) in zip(got, rows, strict=True):
        if nxt is None:
            assert (r["spread"], r["adverse"]) == (0, 0)
            continue
        bid = sell * 0.1 * (1 - max(0, -z) / 2 if max(0, -z) < 2 else 0) * (inv <= 1)
        ask = buy * 0.1 * (1 - max(0, z) / 2 if max(0, z) < 2 else 0) * (inv >= -1)
        inv += bid - ask
        assert (r["spread"], r["fee"], r["adverse"], r["inventory"]) == pytest.approx(
            ((bid + ask) * 5e-5 * m, (bid + ask) * 5e-5 * m, inv * (nxt - m), inv)
        )


def test_volume_buckets_drop_what_goes_beyond(spark):
    df = series(spark, [(4, 10, 0), (7, 10, 0), (25, 10, 9), (5, 10, -9), (4.9, 10, 0)], cols="volume double, limit double, z double")
    got = T.volume_buckets(df, ["symbol"]).orderBy("ts").collect()
    assert [r["bucket"] for r in got] == [None, 0, 1, None, None] and [r["imbalance"] for r in got][1:3] == pytest.approx([0, 1], abs=1e-6)


def test_rolling_functionals_are_causal(spark):
    x = np.random.default_rng(0).normal(size=90)
    full = T.rolling_apply(series(spark, x), ["symbol"], ["x"], 30, 7, lambda v: (v.sum(), v[-1]), "total double, last double")
    part = T.rolling_apply(series(spark, x[:61]), ["symbol"], ["x"], 30, 7, lambda v: (v.sum(), v[-1]), "total double, last double")
    a, b = column(full, "total"), column(part, "total")
    assert a[:61] == b and a[:29] == [None] * 29 and a[29] == pytest.approx(x[:30].sum()) and a[30] == a[29] and a[36] == pytest.approx(x[7:37].sum())
    holes = column(T.rolling_apply(series(spark, [1, None, 1, 1]), ["symbol"], ["x"], 2, 1, lambda v: (v.sum(),), "t double"), "t")
    assert holes == [None, None, None, 2]


@pytest.mark.parametrize(
    "name",
    [
        "returns", "rolling_stats", "wavelet", "fracdiff", "rolling_entropy", "rolling_hill", "causal_scores", "wavelet_band", "scaled_momentum",
        "rolling_functionals", "signature_sums"
    ]
)
def test_features_know_the_past_alone(spark, name, tmp_path):
    """A feature on a prefix of the table equals that on the whole, but for targets and full-sample scales, which say so."""
    from riverbed.plans import registry

    forward = {"returns": ["fwd"], "scaled_momentum": ["scaled"]}.get(name, [])
    data = "/root/testdata/sf0.001"
    cut = dt.datetime(1999, 6, 1)
    line = spark.read.parquet(f"{data}/lineitem.parquet")
    line.where(F.col("l_shipdate") < cut).write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = registry.queries()[name](spark, data).where(F.col("ts") < cut).drop(*forward).toPandas()
    part = registry.queries()[name](spark, str(tmp_path)).drop(*forward).toPandas()
    keys = ["symbol", "ts"]
    a, b = (d.sort_values(keys).reset_index(drop=True) for d in (whole, part))
    pd.testing.assert_frame_equal(a, b)


def test_hurst_by_aggregates_equals_the_functional(spark):
    from riverbed.plans import registry, research

    got = {r["symbol"]: r["hurst"] for r in registry.queries()["hurst_exponents"](spark, "/root/testdata/sf0.001").collect()}
    rows = research._daily_returns(spark, "/root/testdata/sf0.001").where("ret IS NOT NULL").toPandas().sort_values("ts")
    assert got == pytest.approx({k: K.hurst(v["ret"].to_numpy()) for k, v in rows.groupby("symbol")}, abs=1e-5)


def test_windows_and_panels(spark):
    x = np.random.default_rng(0).normal(size=10)
    df = Fn.windows(series(spark, x, ("a", "b")), [], 4, 3)
    got = sorted(
        (r["win"], round(r["s"], 9), r["n"]) for r in Fn.per_panel(
            df, ["win"], "symbol", "x", lambda n, m, t: [(float(m[:, 0].sum()), len(n))], "s double, n int"
        ).collect()
    )
    assert got == [(DAY + dt.timedelta(days=e - 1), round(x[e - 4 : e].sum(), 9), 2) for e in (4, 7, 10)]
    one = Fn.per_series(series(spark, x, ("a", "b")), ["symbol"], ["x"], lambda v: (float(v[0]), K.NAN), "first double, nothing double").collect()
    assert {r["symbol"]: r["first"] for r in one} == pytest.approx({"a": x[0], "b": -x[0]}) and all(r["nothing"] is None for r in one)


def test_fits_by_sums_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = x @ [1.0, -1.0] + 0.5 + rng.normal(size=200)
    up = (y > 0).astype(float)
    df = spark.createDataFrame(
        [(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, up, strict=True)] + [(None, 1.0, 1.0, 1.0)],
        "u double, v double, y double, up double"
    )
    assert fits.ridge(df, ["u", "v"], "y", 5.0) == pytest.approx(K.ridge(x, y, 5.0))
    assert fits.logistic(df, ["u", "v"], "up", 1.0) == pytest.approx(K.logistic(x, up, 1.0), abs=1e-6)


def test_matrix_formulas_equal_columns(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{k}", DAY + dt.timedelta(days=t), *map(float, rng.normal(size=2).round(1)), float(rng.normal())) for t in range(30) for k in range(7)]
    df = spark.createDataFrame(rows, "symbol string, ts date, a double, b double, fwd double")
    p = search.gathered(df, ["a", "b"], "fwd")
    trees = {
        f"f{i}": t for i,
        t in enumerate(
            [(o, ("feat", "a")) for o in search.SINGLE] + [
                (o, ("feat", "a"), ("delay1", ("feat", "b"))) for o in search.PAIRED
            ] + [("neut", ("tsmean3", ("rank", ("delay1", ("feat", "b")))))]
        )
    }
    got = formulas.evaluate(df, trees).toPandas()
    for name, tree in trees.items():
        have = got.pivot(index="ts", columns="symbol", values=name).sort_index().to_numpy(float)
        assert have == pytest.approx(search.value(tree, p), nan_ok=True, abs=1e-9), tree
    s = {r["formula"]: r for r in search.scored(spark, list(trees.values()), p, {"is": slice(0, 25)}).collect()}
    assert s["sign(a)"]["nodes"] == 2 and s["sign(a)"]["ic_is"] == pytest.approx(search.information(np.sign(p.features["a"][:25]), p.forward[:25])[0])
    with pytest.raises(KeyError):
        search.value(("nothing", ("feat", "a")), p)


# ---- books, costs and the six invariants


def test_books_by_hand(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.5, 0.1), ("b", 1, -0.5, 0.2), ("a", 2, -0.5, 0.0), ("b", 2, 0.0, 0.1), ("a", 3, None, 0.3), ("b", 3, 0.5, -0.1)],
        "symbol string, ts int, w double, r double"
    )
    nets = lambda d: [round(x["net"], 9) for x in d.orderBy("ts").collect()]
    assert nets(books.book(df, "r", 100)) == [round(-0.05 - 0.01, 9), round(-0.015, 9), round(-0.05 - 0.01, 9)]
    assert nets(books.book(df, "r", 100, first_free=True))[0] == -0.05
    assert nets(books.book(df, "r", 100, lag=1)) == [0, round(0 - 0.05 - 0.01, 9), round(-0.15 - 0.015, 9)]
    assert nets(books.uneven_book(df, "r", 100, 200)) == [round(-0.05 - 0.005 - 0.01, 9), -0.02, round(-0.05 - 0.005, 9)]
    assert nets(books.borrowing_book(df, "r", 100, 3.65)) == [round(-0.05 - 0.02 - 0.01, 9), round(-0.03 - 0.005, 9), round(-0.05 - 0.02 - 0.005, 9)]
    legs = books.legs(df, "r").orderBy("ts").collect()
    assert (legs[0]["long_leg"], legs[0]["short_leg"]) == pytest.approx((0.05, -0.1))


def test_invariants_of_the_core(spark):
    rng = np.random.default_rng(1)
    good, noise = rng.normal(0.0006, 0.01, 5000), rng.normal(0, 0.01, 5000)
    df = spark.createDataFrame(
        [(n, t, float(v), float(np.sign(v))) for n, x in (("good", good), ("noise", noise)) for t, v in enumerate(x)],
        "name string, ts int, net double, pos double"
    )
    m = {
        r["name"]: r for r in backtest.metrics(df, ["name"], 365).withColumn("psr", backtest.psr()).withColumn(
            "deflated", backtest.psr(F.lit(0.05))
        ).collect()
    }
    assert m["good"]["sharpe_ann"] > 0.8 and m["good"]["psr"] > 0.95 > m["noise"]["psr"]
    # deflation lowers the probability, moments enter it, costs lower the net, the future does not enter the first part
    assert m["good"]["deflated"] < m["good"]["psr"]
    moved = backtest.metrics(df, ["name"], 365).withColumn("skew", F.col("skew") - 5).withColumn("psr", backtest.psr()).where("name = 'good'").first()
    assert moved["psr"] < m["good"]["psr"]
    paid, free = (backtest.net_return(df.withColumnRenamed("net", "ret"), "ret", "pos", b, ["name"]).agg(F.sum("net")).first()[0] for b in (5.0, 0.0))
    assert paid < free
    early = backtest.split(df, ["name"]).where("split = 'is'").agg(F.max("ts")).first()[0]
    assert early < backtest.split(df, ["name"]).where("split = 'oos'").agg(F.min("ts")).first()[0]
    with pytest.raises(NotImplementedError):
        L.cycle(None, None, None, None, live=True)


MUTANTS = {
    "no cost": ("turn * bps", "0 * bps"),
    "no first trade": ('F.lag(position, 1, 0.0)', 'F.lag(position, 1)'),
    "random split": ("F.floor(n * share)", "F.floor(n * (1 - share))"),
    "no skew": ('F.col("skew") * s', "0 * s"),
    "no kurtosis": ('(F.col("kurt") - 1) / 4', "0"),
    "no deflation": ("(s - b)", "s"),
}


@pytest.mark.parametrize("name", MUTANTS)
def test_mutants_of_the_core_are_noticed(spark, name):
    """Each invariant, taken out of the source, changes a result."""
    import inspect
    import types

    old, new = MUTANTS[name]
    source = inspect.getsource(backtest).replace('F.col("turn") * bps', "turn * bps").replace("turn * bps", "turn * bps")
    assert old in source
    broken = types.ModuleType("broken")
    exec(compile(source.replace(old, new), "broken", "exec"), broken.__dict__)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(
        [("a", t, float(rng.exponential(0.01) - 0.008), float(rng.integers(-1, 2) or 1)) for t in range(60)],
        "symbol string, ts int, ret double, pos double"
    )

    def run(m):
        net = m.split(m.net_return(df, "ret", "pos", 5, ["symbol"]), ["symbol"])
        return [
            round(x, 12) if x is not None else None for r in m.metrics(
                net, ["symbol", "split"], 365, "pos"
            ).withColumn("p", m.psr(F.lit(0.05))).orderBy("split").collect() for x in (r["sr_pp"], r["n"], r["p"])
        ]

    assert run(broken) != run(backtest)


def test_probability_columns(spark):
    from statistics import NormalDist

    xs = [-9.0, -6.0, -2.0, 0.0, 0.3, 5.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rel=2e-7)
    ts = [0.5, 0.3, 0.02426, 0.01, 1e-9]
    up = [r[0] for r in spark.createDataFrame([(x,) for x in ts], "x double").select(upper_quantile(F.col("x"))).collect()]
    assert up == pytest.approx([-NormalDist().inv_cdf(t) for t in ts], abs=1e-7)
    row = spark.createDataFrame([(0.1, 55), (0.1, 1)], "v double, n int").select(benchmark(F.col("v"), F.col("n"))).collect()
    assert [r[0] for r in row] == pytest.approx([deflated_benchmark(0.1, 55), 0.0])


# ---- the paper book


def test_paper_book_keeps_its_limits(spark):
    rows = [("B", 2e-4, 1e-5, 0.09, "240927"), ("E", -3e-4, None, 0.01, "240927"), ("S", 1e-5, 5e-4, None, None)]
    snap = spark.createDataFrame(rows, "coin string, funding double, other_funding double, ann double, code string")
    legs = {(r["sleeve"], r["instrument"]): (r["weight"], r["borrow"]) for r in L.legs(snap).collect()}
    assert legs[
        ("carry", "PERP:B")
    ] == (-1, False) and legs[("carry", "SPOT:E")] == (-1, True) and legs[("venue", "PERP:S")] == (1, False) and ("carry", "PERP:S") not in legs
    assert legs[("calendar", "FUT:B_240927")] == (-1, False) and legs[("venue", "PERP:B")] == (-1, False) and len(legs) == 10
    vol = lambda v: spark.createDataFrame([(v,)], "vol double")
    for v in (None, 40.0, 160.0):
        t = {r["instrument"]: r["notional"] for r in L.targets(L.legs(snap), vol(v)).collect()}
        gross = sum(map(abs, t.values()))
        assert gross <= 3 * 1e5 + 1e-6 and max(map(abs, t.values())) <= 5e4 and abs(sum(t.values())) < 0.6 * gross
    assert gross < sum(abs(r["notional"]) for r in L.targets(L.legs(snap), vol(40.0)).collect())
    px = spark.createDataFrame([("PERP:B", 100.0), ("SPOT:B", 99.0), ("OLD", 10.0), ("FUT:B_240927", None)], "instrument string, px double")
    state = spark.createDataFrame([("OLD", 5.0, 8.0), ("PERP:B", -400.0, 101.0), ("GONE", 1.0, 1.0)], "instrument string, qty double, last_px double")
    done = L.cycle(snap, px, vol(None), state)
    assert done["pnl"].first()[0] == pytest.approx(5 * 2 + 400)
    o = {r["instrument"]: r for r in done["orders"].collect()}
    assert o["OLD"]["side"] == o["GONE"]["side"] == "CLOSE" and o["OLD"]["cost"] == 0 and "FUT:B_240927" not in o and "PERP:B" not in o
    assert o["SPOT:B"]["side"] == "BUY" and o["SPOT:B"]["cost"] == pytest.approx(abs(o["SPOT:B"]["qty"]) * 99 * 5e-4)
    kept = {r["instrument"]: r["qty"] for r in done["state"].collect()}
    assert set(kept) == {"PERP:B", "SPOT:B"} and kept["PERP:B"] == pytest.approx(-400)
    empty = L.cycle(snap.limit(0), px, vol(None), state.limit(0))
    assert empty["orders"].count() == 0 and empty["pnl"].first()[0] == 0


# ---- sources, sinks, streams


def test_payloads(spark, tmp_path):
    put = lambda name, doc: (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))
    bar = lambda t, c: [t, "1.5", "2", "1", str(c), "10", t + 1, "15", 7, "4", "6", "0"]
    for d in ("k", "s", "e", "f", "b", "v"):
        (tmp_path / d).mkdir()
    put("k/BTCUSDT.1.json", [bar(0, 1.7), bar(28_800_000, "x"), bar(0, 9)])
    put("k/ETHUSDT.1.json", {"code": -1121, "msg": "no such symbol"})
    rows = payloads.bars(spark, f"{tmp_path}/k", "kline").orderBy("ts").collect()
    assert [(r["symbol"], r["close"], r["trades"], r["taker"]) for r in rows] == [("BTCUSDT", 1.7, 7, 4.0), ("BTCUSDT", None, 7, 4.0)]
    put("s/BTC.json", [[86400, 1, 3, 2, 2.5, 9]])
    low_first = payloads.bars(spark, f"{tmp_path}/s", "daily_low_first").first()
    assert (low_first["low"], low_first["high"], low_first["open"], low_first["ts"]) == (1, 3, 2, dt.datetime(1970, 1, 2))
    put("b/BTC.json", {"result": {"list": [["0", "1", "2", "0.5", "1.1", "3", "4"]]}})
    assert payloads.bars(spark, f"{tmp_path}/b", "venue_kline", "$.result.list").first()["close"] == 1.1
    put("v/BTC.json", {"result": {"data": [[0, 50, 60, 40, 55]]}})
    assert payloads.implied(spark, f"{tmp_path}/v").first()["iv"] == 0.55
    put(
        "f/BTC.json",
        {"result": {"list": [{"fundingRate": "0.0001", "fundingRateTimestamp": "1000"}, {"fundingRate": "bad", "fundingRateTimestamp": "2000"}]}}
    )
    f = payloads.funding(spark, f"{tmp_path}/f", "listed").orderBy("ts").collect()
    assert [r["funding_rate"] for r in f] == [0.0001, None] and payloads.funding(spark, f"{tmp_path}/f", "plain").count() == 0
    c = {
        r["symbol"]: r["state"] for r in payloads.coverage(
            {"k": payloads.bars(spark, f"{tmp_path}/k", "kline"), "f": payloads.funding(spark, f"{tmp_path}/f", "listed")}, 1
        ).collect()
    }
    assert c == {"BTCUSDT": "PARTIAL", "BTC": "PARTIAL"} and payloads.span(payloads.bars(spark, f"{tmp_path}/k", "kline")).first()["n"] == 2


def test_pages_and_patience():
    rows = list(range(0, 100, 7))
    forward = lambda a, b: [r for r in rows if a <= r <= b][:4]
    backward = lambda a, b: [r for r in reversed(rows) if r <= b][:4]
    assert list(payloads.paged(forward, 10, 90, 4, int)) == [r for r in rows if 10 <= r <= 90]
    assert sorted(payloads.paged(backward, 10, 90, 4, int, backward=True)) == [r for r in rows if 10 <= r <= 90]
    answers, waits = iter([(429, None), (500, None), (200, "ok")]), []
    assert payloads.patient(lambda u, p: next(answers), "u", {}, wait=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(ValueError):
        payloads.patient(lambda u, p: (404, None), "u", {})
    with pytest.raises(TimeoutError):
        payloads.patient(lambda u, p: (418, None), "u", {}, 2, lambda s: None)


def test_tick_archives(spark, tmp_path):
    def pack(name, text):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr("t.csv", text)
        (tmp_path / name).write_bytes(b.getvalue())

    pack("BTC-1.zip", "agg_id,price,quantity,first,last,transact_time,is_buyer_maker\n1,10.5,2,1,1,1000,true\n2,11,3,1,1,61000,False\n")
    pack("ETH-1.zip", "1,20,2,1,1,1000,True,True\n")
    got = payloads.tick_archives(spark, str(tmp_path)).orderBy("symbol", "seq").collect()
    assert [(r["symbol"], r["price"], r["qty"], r["maker"], r["seq"]) for r in got] == [
        ("BTC", 10.5, 2, True, 0), ("BTC", 11, 3, False, 1), ("ETH", 20, 2, True, 0)
    ]
    b = bars.flow_bars(payloads.tick_archives(spark, str(tmp_path))).orderBy("symbol", "ts").collect()
    assert [(r["symbol"], r["ofi"], r["ntr"]) for r in b] == [("BTC", -2, 1), ("BTC", 3, 1), ("ETH", -2, 1)]


def test_cache_builds_once_and_not_for_nothing(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3 if len(calls) > 1 else 0)

    assert [cache.cached(spark, str(tmp_path), "t", build).count() for _ in range(3)] == [0, 3, 3] and len(calls) == 2
    assert cache.name("t") == "e358efa489f58062"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1.0, float("nan"), {"a": float("inf")}, [1.0, float("nan")], dt.datetime(2024, 1, 1))],
        "a double, b double, m map<string,double>, l array<double>, t timestamp"
    )
    files.json_report(df, f"{tmp_path}/j")
    doc = json.loads(next(p for p in (tmp_path / "j").glob("part-*") if p.stat().st_size).read_text())
    assert doc["a"] == 1.0 and doc["b"] is None and doc["m"]["a"] is None and doc["l"] == [1.0, None] and doc["t"].startswith("2024-01-01T00:00:00")
    (tmp_path / "n.json").write_text('{"a": NaN}')
    assert math.isnan(files.read_report(spark, f"{tmp_path}/n.json", spark.createDataFrame([], "a double").schema).first()["a"])
    state = spark.createDataFrame([("x", 1e-12, 1.0), ("y", 2.0, 1.0)], "instrument string, qty double, last_px double")
    for _ in range(2):
        files.write_state(state, f"{tmp_path}/state")
        assert [r["instrument"] for r in spark.read.parquet(f"{tmp_path}/state").collect()] == ["y"]
    assert files.lines(state, ["instrument"])[0].split() == ["instrument", "qty", "last_px"]


def test_streams_close_windows_and_keep_states(spark, tmp_path):
    def put(k, rows):
        made = [(i, dt.datetime(2024, 1, 1, 0, m, s), 1, "a", v, '{"k": 1}') for i, m, s, v in rows]
        spark.createDataFrame(
            made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
        ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put(0, [(1, 0, 10, 1.0), (2, 0, 50, 2.0), (2, 0, 50, 2.0), (3, 1, 5, 9.0)])
    t = bars.ticks(spark, f"{tmp_path}/in")
    run = lambda: {(r["ts"].minute, r["ntr"]) for r in bars.drained(bars.flow_bars(t), f"{tmp_path}/bars").collect()}
    assert run() == set()  # no window has ended a minute ago
    put(1, [(4, 3, 30, 5.0), (5, 0, 59, 7.0)])
    assert run() == {(0, 4), (1, 1)} or run() == {(0, 3), (1, 1)}
    put(2, [(6, 0, 30, 7.0), (7, 6, 0, 1.0)])
    got = run()
    assert (3, 1) in got and not any(n > 4 for _, n in got) and (6, 1) not in got  # late rows are dropped, the last bar is open
    d = bars.drained(bars.distinct(t, ["symbol", "seq"]), f"{tmp_path}/distinct")
    assert d.count() == 7 or d.count() == 6
    h = bars.hysteresis(t.withColumn("x", F.col("price") - 4), "x", 3.0, 1.5)
    states = [r["state"] for r in bars.drained(h, f"{tmp_path}/h").orderBy("ts").collect()]
    assert set(states) <= {-1, 0, 1} and len(states) == 8
    seen = []

    def each(batch, held, number):
        total = (held.first()["n"] if held else 0) + batch.count()
        seen.append(number)
        return spark.createDataFrame([(total,)], "n long")

    bars.cycles(t, f"{tmp_path}/c", each)
    assert spark.read.parquet(f"{tmp_path}/c/state/{seen[-1]}").first()["n"] == 8 and seen == list(range(len(seen)))


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 2), (None, 2)], "k string, ts int")
    right = spark.createDataFrame([("a", 2, 5.0), ("a", 3, None), ("b", 3, 1.0), (None, 1, 7.0)], "k string, ts int, v double")
    assert sorted(map(str, joins.asof(left, right, ["k"], ["v"]).collect())) == sorted(
        map(
            str,
            [
                *(
                    spark.createDataFrame(
                        [("a", 1, None), ("a", 3, None), ("a", 3, None), ("b", 2, None), (None, 2, 7.0)], "k string, ts int, v double"
                    ).collect()
                )
            ]
        )
    )
    assert joins.asof(left.limit(0), right, ["k"], ["v"]).count() == 0
    assert joins.lookup(left, spark.createDataFrame([("a", 1.0)], "k string, w double"), "k").count() == 3


def test_names(spark):
    row = spark.createDataFrame([("btc/usd-t", "250627", "Z25", "7, 14,x,30")], "s string, c string, m string, l string").select(
        N.normalized(F.col("s")).alias("s"), N.expiry(F.col("c")).alias("c"), N.month_code(F.col("m")).alias("m"),
        N.month_code(F.lit("A25")).alias("none"), N.numbers(F.col("l"), "int").alias("l"), N.utc(F.lit(0)).alias("u")
    ).first()
    assert (row["s"], row["c"], row["m"], row["none"], row["l"], row["u"]) == (
        "BTCUSDT", dt.date(2025, 6, 27), dt.date(2025, 12, 1), None, [7, 14, 30], dt.datetime(1970, 1, 1)
    )
