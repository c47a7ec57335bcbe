"""Every query against its SQL on the smallest tables, and the core's invariants."""

import glob
import math

import duckdb
import pytest

from riverbed.functions.probability import deflated_benchmark, normal_cdf
from riverbed.operators import backtest, formulas
from riverbed.plans import registry

DATA = "/root/testdata/sf0.001"


def _text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def same(rows, other):
    order = lambda x: sorted(tuple(_text(r[c]) for c in sorted(r)) for r in x)
    assert order(rows) == order(other)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    got = registry.queries()[name](spark, DATA).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    same(got.to_dict("records"), want[list(got.columns)].to_dict("records"))


def test_cost_is_charged_and_first_trade_counts(spark):
    df = spark.createDataFrame([("a", t, 0.01, p) for t, p in enumerate([1.0, 1.0, -1.0])], "symbol string, ts int, ret double, pos double")
    net = [r["net"] for r in backtest.net_return(df, "ret", "pos", 10, ["symbol"]).orderBy("ts").collect()]
    assert net == pytest.approx([0.01 - 0.001, 0.01, -0.01 - 0.002])
    free = backtest.net_return(df, "ret", "pos", 10, ["symbol"], first_trade_free=True).orderBy("ts").first()["net"]
    assert free == pytest.approx(0.01)


def test_split_is_chronological(spark):
    df = spark.createDataFrame([("a", t) for t in range(10)], "symbol string, ts int")
    assert [r["split"] for r in backtest.split(df, ["symbol"]).orderBy("ts").collect()] == ["is"] * 6 + ["oos"] * 4


def test_short_series_has_no_metrics(spark):
    df = spark.createDataFrame([("a", t, 0.01 * t) for t in range(9)], "symbol string, ts int, net double")
    r = backtest.metrics(df, ["symbol"], 365).first()
    assert r["n"] == 9 and r["sr_pp"] is None


def test_normal_cdf_and_benchmark(spark):
    from pyspark.sql import functions as F

    xs = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([(1 + math.erf(x / math.sqrt(2))) / 2 for x in xs], abs=2e-7)
    assert deflated_benchmark(1.0, 1) == 0 and deflated_benchmark(1.0, 100) > deflated_benchmark(1.0, 10) > 0


def test_formula_text_and_size():
    t = ("add", ("rank", ("feat", "a")), ("feat", "b"))
    assert formulas.text(t) == "add(rank(a),b)" and formulas.nodes(t) == 4


def strict(rows):
    """Rows as sorted text, in which no number is not null."""
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[c]) for c in sorted(r)) for r in rows)


def odd_ticks(path):
    """Ticks whose prices are zero once, twice running and only early, or below zero, or never move; quantities add up to zero in some minutes."""
    import datetime as dt
    import random

    import pandas as pd

    rng, rows = random.Random(3), []
    for s in ("once", "twice", "early", "below", "flat", "still", "void"):
        for t in range(240):
            price = 100.0 if s == "flat" else round(rng.uniform(90, 110), 2)
            zero = {"once": t == 200, "twice": t in (210, 211), "early": t in (0, 9)}.get(s, False)
            quantities = [0, 0] if s == "still" else [-1, -1] if s == "void" and t % 40 == 3 else [0, -2] if s == "void" and t % 40 == 7 else [rng.randrange(9), rng.randrange(9)]
            for k, q in enumerate(quantities):
                rows.append((s, dt.datetime(2024, 1, 1, t // 60, t % 60, 10 * k), 0.0 if zero else -price if s == "below" and t == 220 else price, f'{{"k": {q}}}', 2 * len(rows) if s == "still" else len(rows)))
    pd.DataFrame(rows, columns=["event_type", "ts", "value", "props", "event_id"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{path}/events.parquet")


@pytest.mark.parametrize("name", ["flow_ic", "flow_strategy"])
def test_order_flow_over_prices_and_quantities_of_zero_equals_sql(spark, tmp_path, name):
    odd_ticks(tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = [r.asDict() for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    sql = con.execute(registry.oracle_sql()[name])
    want = [dict(zip([c[0] for c in sql.description], r, strict=True)) for r in sql.fetchall()]
    assert strict(got) == strict(want)
    assert {"nan", "early"} <= {v for r in strict(got) for v in r}
