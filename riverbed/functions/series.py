"""Causal column builders over a symbol's rows in time order, and over the symbols of one time."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    """A symbol's rows in time order. Windows are made when a plan is: they need a session."""
    return W.partitionBy("symbol").orderBy("ts")


def by_time() -> WindowSpec:
    """The symbols of one time."""
    return W.partitionBy("ts")


def trailing(n: int) -> WindowSpec:
    """The last n rows, this one included."""
    return by_symbol().rowsBetween(1 - n, 0)


def lagged(c: Column | str, k: int = 1, default=None) -> Column:
    """The value k rows earlier: what may be known when a position is taken."""
    return F.lag(c, k, default).over(by_symbol())


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers divide: by zero infinite, or no number for zero over zero, where Spark's division raises. Null if either is null."""
    return F.when(b == 0, F.signum(a) * float("inf")).otherwise(F.try_divide(a, b))


def logarithm(x: Column) -> Column:
    """The natural logarithm as floating-point numbers have it: -infinity at zero and no number below, where Spark's is null."""
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.log(x))


def simple_return(c: str, k: int = 1) -> Column:
    return F.try_divide(F.col(c), lagged(c, k)) - 1


def log_return(c: str) -> Column:
    return F.log(c) - F.log(lagged(c))


def forward_return(c: str, k: int = 1) -> Column:
    return F.try_divide(F.lead(c, k).over(by_symbol()), F.col(c)) - 1


def full(n: int, value: Column) -> Column:
    """value once n rows have been seen."""
    return F.when(F.row_number().over(by_symbol()) >= n, value)


def rolling_mean(c: Column | str, n: int) -> Column:
    """Nulls count as zero; null for the first n - 1 rows."""
    return full(n, F.sum(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))).over(trailing(n)) / n)


def rolling_std_pop(c: str, n: int) -> Column:
    mean, square = F.avg(c).over(trailing(n)), F.avg(F.col(c) * F.col(c)).over(trailing(n))
    return full(n, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))))


def rolling(fn, n: int, *cols: str, least: int | None = None) -> Column:
    """An aggregate over the last n rows, null below `least` (n) values of the first column."""
    return F.when(F.count(cols[0]).over(trailing(n)) >= (least or n), fn(*cols).over(trailing(n)))


def zscore(c: str, n: int, least: int) -> Column:
    mean, sd, seen = F.avg(c).over(trailing(n)), F.stddev_samp(c).over(trailing(n)), F.count(c).over(trailing(n))
    return F.when((seen >= least) & (sd > 0), (F.col(c) - mean) / sd)


def hold(value: Column, every: int) -> Column:
    """The value of every k-th row, kept until the next."""
    at = F.row_number().over(by_symbol()) - 1
    return F.last(F.when(at % every == 0, value), True).over(by_symbol().rowsBetween(W.unboundedPreceding, 0))


def average_rank(c: str) -> Column:
    """Rank among the symbols of a time; ties share the mean of their ranks, nulls have none."""
    ordered = W.partitionBy("ts", F.col(c).isNull()).orderBy(c)
    ties = W.partitionBy("ts", c)
    return F.when(F.col(c).isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def row_zscore(c: str, clip: float = 4.0) -> Column:
    z = (F.col(c) - F.avg(c).over(by_time())) / (F.stddev_pop(c).over(by_time()) + 1e-9)
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), z))


def neutral(c: str) -> Column:
    return F.col(c) - F.avg(c).over(by_time())
