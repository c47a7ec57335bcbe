"""Registry of queries: a Spark plan and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
_home: dict[str, str] = {}
PLACES = 6
#: Added before rounding, so that exact halves round alike on both sides.
NUDGE = 3.1e-10
#: Columns that are given as timestamps, also where they are dates inside.
TIMES = ("ts", "week")


def _rounded(floats: str) -> list[tuple[str, int, float]]:
    """(column, places, nudge) of each entry "name" or "name:places": small quantities are compared to more places, in their own unit."""
    pairs = [(x.split(":") + [str(PLACES)])[:2] for x in floats.split()]
    return [(c, int(k), NUDGE * 10.0 ** (PLACES - int(k))) for c, k in pairs]


def query(sql: str | None = None, floats: str = "", exact: str = ""):
    """Registers a plan. sql: a query whose result has the columns named in exact and floats; those in floats are rounded on both sides, since sums in another order differ in the last bits."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        f, e = _rounded(floats), exact.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            if not f and not e:
                return df
            keys = [F.col(c).cast("timestamp").alias(c) if c in TIMES else F.col(c) for c in e]
            return df.select(*keys, *[(F.round(F.col(c) + nudge, k) + 0.0).alias(c) for c, k, nudge in f])

        _queries[fn.__name__], _home[fn.__name__] = run, fn.__module__
        if sql:
            head, body = sql.rsplit("\nSELECT", 1) if "\nSELECT" in sql else ("", sql.removeprefix("SELECT"))
            keys = [f"CAST({c} AS TIMESTAMP) AS {c}" if c in TIMES else c for c in e]
            values = [f"round({c} + {nudge!r}, {k}) + 0.0 AS {c}" for c, k, nudge in f]
            _sql[fn.__name__] = f"{head}\nSELECT {', '.join([*keys, *values])} FROM (SELECT{body})" if f or e else sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from riverbed.plans import backtests, books, exotic, live, machines, panel_ops, probes, research, search, statistics, strategies, streams  # noqa: F401

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["battery"](spark, sf_dir)
