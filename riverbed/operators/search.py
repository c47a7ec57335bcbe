"""Search over formula trees: formulas are rows, evaluated in parallel against one panel of checked size.

A panel of times by symbols is small beside the ticks that it was made of, and a search tries thousands of formulas on it, so the formulas are dealt over the cluster and the panel
goes to each task. A panel of more than CELLS values is refused; `formulas.evaluate` works on it in place, as columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions import kernels as K
from riverbed.operators import formulas

#: Values of a panel, all features together, that are sent to every task: 160 MB.
CELLS = 20_000_000
SIZE_COST = 0.002


@dataclass(frozen=True)
class Panel:
    """Features and forward returns as matrices, times down and symbols across; NaN where there is no value."""

    features: dict[str, np.ndarray]
    forward: np.ndarray
    times: tuple
    symbols: tuple


def gathered(df: DataFrame, features: list[str], forward: str, ragged: bool = False) -> Panel:
    """The panel of df (symbol, ts, features, forward) on the times that all symbols share, or with holes on all times."""
    n = df.count() * (len(features) + 1)
    if n > CELLS:
        raise ValueError(f"a panel of {n} values is too large to send to every task")
    rows = df.select("symbol", "ts", *features, forward).toPandas()
    wide = {c: rows.pivot(index="ts", columns="symbol", values=c).sort_index() for c in (*features, forward)}
    whole = rows.groupby("ts")["symbol"].nunique()
    keep = whole.index[whole >= (1 if ragged else rows["symbol"].nunique())].sort_values()
    cut = {c: w.loc[keep].to_numpy(float) for c, w in wide.items()}
    return Panel({c: cut[c] for c in features}, cut[forward], tuple(keep), tuple(wide[forward].columns))


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks along rows, ties sharing their mean; NaN stays."""
    return pd.DataFrame(x).rank(axis=1).to_numpy()


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    out = np.full_like(x, np.nan)
    out[k:] = x[:-k]
    return out


def _mean(x: np.ndarray, d: int) -> np.ndarray:
    total = np.cumsum(np.nan_to_num(x), 0)
    out = np.full_like(x, np.nan)
    out[d - 1 :] = (total[d - 1 :] - np.vstack((np.zeros((1, x.shape[1])), total[:-d]))) / d
    return out


def _spread(x: np.ndarray, d: int) -> np.ndarray:
    """Deviation over the known values of d rows."""
    rows = pd.DataFrame(x).rolling(d, min_periods=1)
    out = rows.std(ddof=0).to_numpy()
    out[: d - 1] = np.nan
    return out


def _rank(x: np.ndarray) -> np.ndarray:
    m = np.isfinite(x).sum(1, keepdims=True)
    return np.where(m > 1, ranks(x) / np.maximum(m, 1) - 0.5, np.nan)


def _neutral(x: np.ndarray) -> np.ndarray:
    known = np.isfinite(x)
    return x - np.where(known, x, 0).sum(1, keepdims=True) / np.maximum(known.sum(1, keepdims=True), 1)


#: The same operators as `formulas.OPS`, on matrices.
MATRIX_OPS = {
    "add": np.add,
    "sub": np.subtract,
    "mul": np.multiply,
    "div": lambda a, b: np.where(np.abs(b) > 1e-9, a / np.where(np.abs(b) > 1e-9, b, 1.0), 1.0),
    "neg": np.negative,
    "abs": np.abs,
    "sign": np.sign,
    "sqrt": lambda a: np.sqrt(np.abs(a)),
    "rank": _rank,
    "neut": _neutral,
    "tsmean3": lambda a: _mean(a, 3),
    "tsmean10": lambda a: _mean(a, 10),
    "tsstd10": lambda a: _spread(a, 10),
    "tsdelta5": lambda a: a - _shifted(a, 5),
    "delay1": lambda a: _shifted(a, 1),
}
PAIRED = ("add", "sub", "mul", "div")
SINGLE = tuple(k for k in MATRIX_OPS if k not in PAIRED)


def value(tree: tuple, panel: Panel) -> np.ndarray:
    with np.errstate(all="ignore"):
        return panel.features[tree[1]] if tree[0] == "feat" else MATRIX_OPS[tree[0]](*(value(t, panel) for t in tree[1:]))


def parsed(text: str) -> tuple:
    """The tree that `formulas.text` writes."""
    at = 0

    def read() -> tuple:
        nonlocal at
        start = at
        while at < len(text) and text[at] not in "(),":
            at += 1
        name = text[start:at]
        if at == len(text) or text[at] != "(":
            return ("feat", name)
        args = []
        while text[at] != ")":
            at += 1
            args.append(read())
        at += 1
        return (name, *args)

    return read()


def grown(rng: np.random.Generator, features: list[str], depth: int) -> tuple:
    """A random tree: a leaf at the bottom, and early in three cases of ten below the third level."""
    early = rng.random() < 0.3 if depth > 0 else False
    if depth <= 0 or (early and depth < 3):
        return ("feat", str(rng.choice(features)))
    ops, width = (SINGLE, 1) if rng.random() < 0.5 else (PAIRED, 2)
    return (str(rng.choice(ops)), *(grown(rng, features, depth - 1) for _ in range(width)))


def mutated(rng: np.random.Generator, tree: tuple, features: list[str]) -> tuple:
    """The tree with parts grown anew: a leaf always, other nodes in three cases of ten, else their children in four of ten."""
    if tree[0] == "feat" or rng.random() < 0.3:
        return grown(rng, features, int(rng.integers(1, 4)))
    return (tree[0], *(mutated(rng, t, features) if rng.random() < 0.4 else t for t in tree[1:]))


def population(seed: int, size: int, features: list[str]) -> list[tuple]:
    """Distinct random trees, `size` attempts."""
    rng = np.random.default_rng(seed)
    made = {formulas.text(t): t for t in (grown(rng, features, int(rng.integers(2, 5))) for _ in range(size))}
    return list(made.values())


def information(alpha: np.ndarray, forward: np.ndarray) -> tuple[float, float]:
    """Mean rank correlation over days with more than four names, and in its deviations; zeros at twenty days or fewer."""
    both = np.isfinite(alpha) & np.isfinite(forward)
    a, f = ranks(np.where(both, alpha, np.nan)), ranks(np.where(both, forward, np.nan))
    n = both.sum(1)
    with np.errstate(all="ignore"):
        da, df = a - np.nanmean(a, 1, keepdims=True), f - np.nanmean(f, 1, keepdims=True)
        ic = np.nansum(da * df, 1) / np.sqrt(np.nansum(da * da, 1) * np.nansum(df * df, 1))
    ic = ic[(n > 4) & np.isfinite(ic)]
    return (float(ic.mean()), float(ic.mean() / (ic.std() + 1e-9))) if len(ic) > 20 else (0.0, 0.0)


def weights(alpha: np.ndarray) -> np.ndarray:
    """Demeaned ranks to gross one on days with more than four names."""
    n = np.isfinite(alpha).sum(1, keepdims=True)
    d = np.nan_to_num(_neutral(ranks(alpha)))
    return np.where(n > 4, d / (np.abs(d).sum(1, keepdims=True) + 1e-9), 0.0)


def long_short(alpha: np.ndarray, forward: np.ndarray, bps: float = 5.0, lag: int = 1) -> np.ndarray:
    """Net return by day of weights `lag` days old, turnover of the weights charged the day they change."""
    w = weights(alpha)
    old = np.vstack((np.zeros((1, w.shape[1])), w[:-1]))
    held = old if lag else w
    return (held * np.nan_to_num(forward)).sum(1) - bps / 1e4 * np.abs(w - old).sum(1)


def scored(spark: SparkSession, trees: list[tuple], panel: Panel, slices: dict[str, slice]) -> DataFrame:
    """formula, nodes, and ic_<s>, icir_<s> for each slice: a row for each tree, evaluated where its row is. Formulas that fail or have no value are left out."""
    sent = spark.sparkContext.broadcast(panel)
    names = [f"{m}_{s}" for s in slices for m in ("ic", "icir")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = sent.value
        for pdf in batches:
            rows = []
            for text in pdf["formula"]:
                a = value(parsed(text), p)
                if np.isfinite(a).any():
                    rows.append([text, formulas.nodes(parsed(text)), *(v for s in slices.values() for v in information(a[s], p.forward[s]))])
            yield pd.DataFrame(rows, columns=["formula", "nodes", *names])

    texts = [(formulas.text(t),) for t in trees]
    dealt = spark.createDataFrame(texts, "formula string").repartition(max(1, min(len(texts), spark.sparkContext.defaultParallelism * 4)))
    return dealt.mapInPandas(run, "formula string, nodes int, " + ", ".join(f"{n} double" for n in names))


def best(spark: SparkSession, trees: list[tuple], panel: Panel, train: slice, most: int) -> list[tuple[float, float, str]]:
    """(fitness, icir, formula) of the `most` fittest trees in sample; ties by text."""
    s = scored(spark, trees, panel, {"is": train})
    top = s.withColumn("fit", F.abs("icir_is") - SIZE_COST * F.col("nodes")).orderBy(F.desc("fit"), "formula").limit(most)
    return [(r["fit"], r["icir_is"], r["formula"]) for r in top.collect()]


def evolved(
    spark: SparkSession, panel: Panel, train: slice, seed: int, size: int, elite: int = 40, rounds: int = 3
) -> list[tuple[float, float, str]]:
    """The elite of a random population after rounds of mutation, judged in sample alone; each round is one job."""
    features = list(panel.features)
    top = best(spark, population(seed, size, features), panel, train, elite)
    rng = np.random.default_rng(seed + 1)
    for _ in range(rounds):
        young = [mutated(rng, parsed(t), features) for _, _, t in top]
        every = {formulas.text(t): t for t in [*(parsed(x[2]) for x in top), *young]}
        top = best(spark, list(every.values()), panel, train, elite)
    return top


def zscored(x: np.ndarray) -> np.ndarray:
    x = np.nan_to_num(x)
    return np.clip((x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-9), -4, 4)


def aligned(found: list[tuple[float, float, str]], panel: Panel) -> np.ndarray:
    """Standardised values of formulas, turned so that each foretells upward in sample."""
    return np.stack([zscored(np.sign(icir) * np.nan_to_num(value(parsed(t), panel))) for _, icir, t in found])


def combinations(z: np.ndarray, icir: np.ndarray, panel: Panel, train: slice) -> dict[str, np.ndarray]:
    """Signals of many made one: equal, by their ratio, by those that are apart from each other, and by a ridge in sample."""
    flat = z[:, train].reshape(len(z), -1)
    apart = K.greedy_apart(np.corrcoef(flat), 25, 0.5)
    y = panel.forward[train].ravel()
    ok = np.isfinite(y)
    w = K.ridge(flat[:, ok].T, y[ok], 10.0)
    return {
        "equal": z.mean(0),
        "by_ratio": np.tensordot(np.abs(icir) / np.abs(icir).sum(), z, 1),
        "apart": z[apart].mean(0),
        "ridge": np.tensordot(w[:-1], z, 1) + w[-1],
    }


def fifths(alpha: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """Mean forward return of each fifth of the names, over days with ten at least; ties by column."""
    rows = []
    for a, f in zip(alpha, forward, strict=True):
        ok = np.flatnonzero(np.isfinite(a) & np.isfinite(f))
        if len(ok) >= 10:
            order = ok[np.argsort(a[ok], kind="stable")]
            rows.append([f[part].mean() for part in np.split(order, [len(order) * q // 5 for q in range(1, 5)])])
    return np.mean(rows, 0) if rows else np.full(5, np.nan)
