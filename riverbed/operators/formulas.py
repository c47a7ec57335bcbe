"""Formula trees compiled to staged columns.

A tree is ("feat", name) or (operator, child, ...). Every distinct sub-tree becomes one column, so that shared parts are worked out once and no expression nests windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.functions import series as S

ROW_OPS = {
    "add": lambda a, b: F.col(a) + F.col(b),
    "sub": lambda a, b: F.col(a) - F.col(b),
    "mul": lambda a, b: F.col(a) * F.col(b),
    "div": lambda a, b: F.when(F.abs(F.col(b)) > 1e-9, F.try_divide(F.col(a), F.col(b))).otherwise(1.0),
    "neg": lambda a: -F.col(a),
    "abs": lambda a: F.abs(a),
    "sign": lambda a: F.signum(a),
    "sqrt": lambda a: F.sqrt(F.abs(a)),
}


def _rank(a: str) -> Column:
    n = F.count(a).over(S.by_time())
    return F.when(n > 1, S.average_rank(a) / n - 0.5)


WINDOW_OPS = {
    "rank": _rank,
    "neut": S.neutral,
    "tsmean3": lambda a: S.rolling_mean(a, 3),
    "tsmean10": lambda a: S.rolling_mean(a, 10),
    "tsstd10": lambda a: S.rolling_std_pop(a, 10),
    "tsdelta5": lambda a: F.col(a) - S.lagged(a, 5),
    "delay1": lambda a: S.lagged(a),
}
OPS = ROW_OPS | WINDOW_OPS


def text(tree: tuple) -> str:
    return tree[1] if tree[0] == "feat" else f"{tree[0]}({','.join(map(text, tree[1:]))})"


def nodes(tree: tuple) -> int:
    return 1 if tree[0] == "feat" else 1 + sum(map(nodes, tree[1:]))


def evaluate(panel: DataFrame, trees: dict[str, tuple]) -> DataFrame:
    """panel with a column for each named tree. Unknown operators raise KeyError."""
    done: dict[str, str] = {}
    df = panel

    def visit(tree: tuple) -> str:
        nonlocal df
        if tree[0] == "feat":
            return tree[1]
        if (key := text(tree)) not in done:
            args = [visit(t) for t in tree[1:]]
            name = f"_node{len(done)}"
            df = df.withColumn(name, OPS[tree[0]](*args))
            done[key] = name
        return done[key]

    found = {name: visit(tree) for name, tree in trees.items()}
    return df.select(*panel.columns, *[F.col(c).alias(name) for name, c in found.items()])
