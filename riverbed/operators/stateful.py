"""Sequential operators: a state carried over the rows of each key in order.

`scan` deals rows by key, sorts each partition by key and order, and walks it batch by batch. A task holds one Arrow batch and one state, however long a key's
history is, so a key that holds a third of all rows costs one task's time and never its memory. Where a state depends on the latest decisive row alone,
window functions do the same inside the JVM (`latest`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverbed.functions import series as S

Step = Callable[[Any, tuple], tuple[Any, tuple]]


def scan(df: DataFrame, keys: list[str], order: list[str], cols: list[str], start: Callable[[], Any], step: Step, out: str) -> DataFrame:
    """keys, order and the columns of `out` for each row.

    step(state, values of cols) gives the next state and the row's outputs; start() gives a key's first state. Null numbers arrive as NaN. Rows of equal order follow
    each other in any order, so `order` should be unique within a key. A null key is a key like others. An empty table gives an empty result.
    """
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, *order]) + ", " + out
    names = [x.split()[0] for x in out.split(",")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = None, None
        for pdf in batches:
            key_rows = list(zip(*(pdf[k].tolist() for k in keys), strict=True)) if keys else [()] * len(pdf)
            rows = []
            for key, values in zip(key_rows, zip(*(pdf[c].tolist() for c in cols), strict=True), strict=True):
                key = tuple(None if x != x else x for x in key)
                if last is None or key != last:
                    state, last = start(), key
                state, result = step(state, values)
                rows.append(result)
            made = pdf[[*keys, *order]].copy()
            for i, name in enumerate(names):
                made[name] = [r[i] for r in rows]
            yield made

    dealt = df.select(*dict.fromkeys([*keys, *order, *cols]))
    dealt = dealt.repartition(*keys) if keys else dealt.coalesce(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def latest(decision: Column, start: int | float = 0) -> Column:
    """The state of a machine whose next state depends on the row alone, or is the last one where decision is null."""
    past = S.by_symbol().rowsBetween(W.unboundedPreceding, 0)
    return F.coalesce(F.last(decision, True).over(past), F.lit(start))


def ewm(df: DataFrame, keys: list[str], value: str, span: int, name: str = "ema") -> DataFrame:
    """Exponential mean e = a x + (1 - a) e, seeded with the first value; a null keeps the last one."""
    a = 2.0 / (span + 1)

    def step(e: float | None, row: tuple) -> tuple:
        x = row[0]
        if x != x:
            return e, (e,)
        e = x if e is None else a * x + (1 - a) * e
        return e, (e,)

    return scan(df, keys, ["ts"], [value], lambda: None, step, f"{name} double")


def ewm_grid(df: DataFrame, keys: list[str], value: str, spans: tuple[int, ...]) -> DataFrame:
    """keys, ts and e<span> for each span, all in one pass."""
    rates = [2.0 / (s + 1) for s in spans]

    def step(state: list | None, row: tuple) -> tuple:
        x = row[0]
        if x == x:
            state = [x] * len(rates) if state is None else [a * x + (1 - a) * e for a, e in zip(rates, state, strict=True)]
        return state, tuple(state or [None] * len(rates))

    return scan(df, keys, ["ts"], [value], lambda: None, step, ", ".join(f"e{s} double" for s in spans))


def pair_position(df: DataFrame, keys: list[str], z: str, enter: float = 2.0, leave: float = 0.5) -> DataFrame:
    """state: -1 from above enter until below leave, +1 from below -enter until above -leave, never straight from one to the other; an unknown score keeps it."""

    def step(state: int, row: tuple) -> tuple:
        x = row[0]
        if x == x:
            if state == 0:
                state = -1 if x > enter else 1 if x < -enter else 0
            elif state * x > -leave:
                state = 0
        return state, (state,)

    return scan(df, keys, ["ts"], [z], lambda: 0, step, "state int")


def timed_position(df: DataFrame, keys: list[str], signal: str, bars: int, refresh: bool) -> DataFrame:
    """state: a signal of -1 or 1 held for `bars` rows from its own on. refresh: a new signal starts the time again and may turn the state; otherwise it is ignored meanwhile."""

    def step(state: tuple[int, int], row: tuple) -> tuple:
        side, left = state
        x = 0 if row[0] != row[0] else int(row[0])
        if x and (refresh or left == 0):
            side, left = x, bars
        now = side if left > 0 else 0
        return (side, max(0, left - 1)), (now,)

    return scan(df, keys, ["ts"], [signal], lambda: (0, 0), step, "state int")


def kalman_hedge(df: DataFrame, keys: list[str], x: str, y: str, delta: float = 1e-4, noise: float = 1e-3) -> DataFrame:
    """beta, alpha, resid of y = beta x + alpha + e with coefficients on a random walk: resid is what was not foreseen before the row was seen. Rows without x or y keep the state."""
    drift = delta / (1 - delta)

    def start() -> tuple:
        return 0.0, 0.0, 1.0, 0.0, 1.0

    def step(state: tuple, row: tuple) -> tuple:
        b, a, pbb, pba, paa = state
        u, v = row
        if u != u or v != v:
            return state, (b, a, None)
        pbb, paa = pbb + drift, paa + drift
        e = v - (b * u + a)
        gb, ga = pbb * u + pba, pba * u + paa
        s = gb * u + ga + noise
        kb, ka = gb / s, ga / s
        state = b + kb * e, a + ka * e, pbb - kb * gb, pba - kb * ga, paa - ka * ga
        return state, (state[0], state[1], e)

    return scan(df, keys, ["ts"], [x, y], start, step, "beta double, alpha double, resid double")


def market_maker(bars: DataFrame, keys: list[str], skew: float, half_spread_bp: float, fee_bp: float, share: float, cap: float) -> DataFrame:
    """spread, fee, adverse, inventory of a passive quoter over bars (ts, mid, next_mid, sell_agg, buy_agg, z).

    z: order-flow pressure as known before the bar. Each side takes `share` of the aggressive volume, less up to half of it where pressure runs against it and skew is 1.
    A side that would add to an inventory beyond cap takes nothing. The last bar of a key, without a next price, earns nothing.
    """

    def step(inv: float, row: tuple) -> tuple:
        mid, after, sell, buy, z = row
        if after != after:
            return inv, (0.0, 0.0, 0.0, inv)
        bid = 0.0 if inv > cap else sell * share * min(1.0, max(0.0, 1 - skew * max(0.0, -z) / 2))
        ask = 0.0 if inv < -cap else buy * share * min(1.0, max(0.0, 1 - skew * max(0.0, z) / 2))
        inv += bid - ask
        return inv, ((bid + ask) * half_spread_bp / 1e4 * mid, -(bid + ask) * fee_bp / 1e4 * mid, inv * (after - mid), inv)

    out = "spread double, fee double, adverse double, inventory double"
    return scan(bars, keys, ["ts"], ["mid", "next_mid", "sell_agg", "buy_agg", "z"], lambda: 0.0, step, out)


def volume_buckets(bars: DataFrame, keys: list[str]) -> DataFrame:
    """bucket, imbalance per row, null unless the row closes a bucket. bars: ts, volume, limit (volume that closes a bucket), z (price change in deviations).

    Volume is split into bought and sold by the normal distribution of z. A bucket closes when its volume reaches the limit, and what goes beyond it is dropped.
    """

    def step(state: tuple, row: tuple) -> tuple:
        n, buy, sell = state
        volume, limit, z = row
        up = 0.5 * math.erfc(-z / math.sqrt(2))
        buy, sell = buy + volume * up, sell + volume * (1 - up)
        if limit > 0 and buy + sell >= limit * (1 - 1e-12):
            return (n + 1, 0.0, 0.0), (n, abs(buy - sell) / (buy + sell + 1e-9))
        return (n, buy, sell), (None, None)

    return scan(bars, keys, ["ts"], ["volume", "limit", "z"], lambda: (0, 0.0, 0.0), step, "bucket long, imbalance double")


def band_basket(ranks: DataFrame, keys: list[str], side: int, band: int) -> DataFrame:
    """ts, members: incumbents stay while they rank within side + band, free places go to the best; rows: keys, ts, names (best first)."""

    def step(held: list, row: tuple) -> tuple:
        names = list(row[0])
        place = {x: i for i, x in enumerate(names)}
        stay = [x for x in held if x in place and place[x] < side + band]
        stay = sorted(stay, key=place.__getitem__)[:side]
        held = stay + [x for x in names if x not in stay][: side - len(stay)]
        return held, (sorted(held),)

    return scan(ranks, keys, ["ts"], ["names"], list, step, "members array<string>")


def score_book(df: DataFrame, keys: list[str], open_: float = 1.25, close: float = 0.5) -> DataFrame:
    """state of a mean-reversion score s with a flag ok: not ok is flat; flat goes long below -open, short above open; a position ends where |s| < close."""

    def step(state: int, row: tuple) -> tuple:
        s, ok = row
        if s != s or not ok:
            state = 0
        elif state == 0:
            state = 1 if s < -open_ else -1 if s > open_ else 0
        elif abs(s) < close:
            state = 0
        return state, (state,)

    return scan(df, keys, ["ts"], ["s", "ok"], lambda: 0, step, "state int")


def rolling_apply(df: DataFrame, keys: list[str], cols: list[str], window: int, every: int, fn: Callable[..., tuple], out: str) -> DataFrame:
    """fn over the last `window` rows of cols, at every `every`-th row from the first full window on; rows between keep the last result, rows before have nulls.

    fn takes one array per column and returns the values of `out`; windows with a missing value give nulls. A task holds one window, not a history.
    """
    names = [x.split()[0] for x in out.split(",")]
    none = (None,) * len(names)

    def start() -> list:
        return [[np.empty(0)] * len(cols), 0, none]

    def step(state: list, row: tuple) -> tuple:
        past, seen, value = state
        past = [np.append(p[-(window - 1) :] if window > 1 else p[:0], x) for p, x in zip(past, row, strict=True)]
        seen += 1
        if seen >= window and (seen - window) % every == 0:
            value = none if any(np.isnan(p).any() for p in past) else tuple(None if x is None or x != x else float(x) for x in fn(*past))
        return [past, seen, value], value

    return scan(df, keys, ["ts"], cols, start, step, out)
