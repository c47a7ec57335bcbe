"""Functionals over whole series: one Arrow group a key, for what neither windows nor aggregates can say."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_series(df: DataFrame, keys: list[str], cols: list[str], fn: Callable[..., tuple], out: str) -> DataFrame:
    """keys and the values of `out` that fn makes of the key's columns, arrays in order of ts. NaN becomes null; a key's history is one group, as its recursion needs."""
    names = [x.split()[0] for x in out.split(",")]
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + out

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        values = fn(*(pdf[c].to_numpy(float) for c in cols))
        return pd.DataFrame([[*key, *(None if isinstance(v, float) and v != v else v for v in values)]], columns=[*keys, *names])

    return df.select(*dict.fromkeys([*keys, "ts", *cols])).groupBy(*keys).applyInPandas(run, schema)


def per_panel(df: DataFrame, keys: list[str], by: str, value: str, fn: Callable[[list, np.ndarray, list], list[tuple]], out: str) -> DataFrame:
    """The rows that fn(names, matrix, times) makes of a key's panel: times down, names across, only times at which every name has a value.

    Panels are small by design: one window of a few dozen names. A key is one group.
    """
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + out
    names = [x.split()[0] for x in out.split(",")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="ts", columns=by, values=value).sort_index().dropna()
        rows = fn(list(wide.columns), wide.to_numpy(float), list(wide.index)) if len(wide) else []
        clean = [[*key, *(None if isinstance(v, float) and v != v else v for v in r)] for r in rows]
        return pd.DataFrame(clean, columns=[*keys, *names])

    return df.select(*dict.fromkeys([*keys, "ts", by, value])).groupBy(*keys).applyInPandas(run, schema)


def windows(df: DataFrame, keys: list[str], size: int, every: int) -> DataFrame:
    """df with (win) for each window of `size` distinct times, `every` apart, that a row falls into; win is the window's last time. A row is in size / every windows.

    Times are numbered over all keys that share them, which is one row a time.
    """
    number = df.select(*keys, "ts").distinct()
    order = W.partitionBy(*keys).orderBy("ts") if keys else W.orderBy("ts")
    number = number.withColumn("_i", F.row_number().over(order))
    # row i is in the windows that end at e with i <= e < i + size and (e - size) divisible by every
    ends = F.expr(f"filter(sequence(_i, _i + {size - 1}), e -> e >= {size} AND (e - {size}) % {every} = 0)")
    spread = number.select(*keys, "ts", F.explode(ends).alias("_e"))
    last = number.select(*keys, F.col("ts").alias("win"), F.col("_i").alias("_e"))
    return df.join(spread.join(last, [*keys, "_e"]).drop("_e"), [*keys, "ts"])
