"""Answers of public market-data services, saved as files, read into one schema; and how such answers are asked for, page by page.

No service is called here: `paged` and `patient` take the function that does. A payload file holds one JSON document. An answer that reports an error gives no rows.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The fields of a bar, in the order in which services send them; times in milliseconds, or seconds where said.
KLINE = ("ts", "open", "high", "low", "close", "volume", "close_time", "qvol", "trades", "taker", "taker_quote")
LAYOUTS = {
    "kline": (KLINE, 1000),
    "venue_kline": (("ts", "open", "high", "low", "close", "volume", "qvol"), 1000),
    "daily_low_first": (("ts", "low", "high", "open", "close", "volume"), 1),
    "daily_vwap": (("ts", "open", "high", "low", "close", "vwap", "volume", "trades"), 1),
}
BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, qvol double, trades bigint, taker double"


def first_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the first as files and their rows follow each other."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_file", "_pos"))
    return df.withColumn("_n", place).where("_n = 1").drop("_n", "_file", "_pos")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """_file, symbol (the file's name up to its first dot), text."""
    named = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("_file"), named.alias("symbol"), F.col("value").alias("text")
    )


def bars(spark: SparkSession, path: str, layout: str, at: str = "$") -> DataFrame:
    """Bars of arrays at a JSON path of each file, first of equal times; a document without that array, an error for instance, gives none."""
    names, unit = LAYOUTS[layout]
    rows = F.from_json(F.get_json_object("text", at), "array<array<string>>")
    r = _documents(spark, path).select("_file", "symbol", F.posexplode(rows).alias("_pos", "_row"))
    at_ = {n: F.get("_row", F.lit(k)) for k, n in enumerate(names)}
    made = r.select("_file", "_pos", "symbol", *[c.alias(n) for n, c in at_.items()])
    number = lambda n, kind="double": (F.col(n).try_cast(kind) if n in names else F.lit(None).cast(kind)).alias(n)
    ts = F.timestamp_millis((F.col("ts").try_cast("double") * (1000 // unit)).cast("bigint")).alias("ts")
    typed = made.select(
        "_file", "_pos", "symbol", ts, *[number(c) for c in ("open", "high", "low", "close", "volume", "qvol")], number("trades", "bigint"),
        number("taker")
    )
    return first_of(typed.where("ts IS NOT NULL"), ["symbol", "ts"])


def records(spark: SparkSession, path: str, at: str, time_field: str, fields: dict[str, str]) -> DataFrame:
    """symbol, ts and the given fields (name in the document: column) of arrays of objects, first of equal times: funding, open interest, ratios of takers."""
    shape = "array<struct<" + ", ".join(f"`{f}`:string" for f in dict.fromkeys([time_field, *fields])) + ">>"
    r = _documents(spark, path).select("_file", "symbol", F.posexplode(F.from_json(F.get_json_object("text", at), shape)).alias("_pos", "_row"))
    ts = F.timestamp_millis(F.col("_row")[time_field].try_cast("bigint")).alias("ts")
    typed = r.select("_file", "_pos", "symbol", ts, *[F.col("_row")[f].try_cast("double").alias(c) for f, c in fields.items()])
    return first_of(typed.where("ts IS NOT NULL"), ["symbol", "ts"])


#: Where services put their records, and what these are called.
FUNDING = {
    "plain": ("$", "fundingTime", {"fundingRate": "funding_rate"}),
    "listed": ("$.result.list", "fundingRateTimestamp", {"fundingRate": "funding_rate"}),
    "data": ("$.data", "fundingTime", {"fundingRate": "funding_rate"}),
}
OPEN_INTEREST = ("$", "timestamp", {"sumOpenInterest": "open_interest", "sumOpenInterestValue": "open_interest_value"})
TAKERS = ("$", "timestamp", {"buySellRatio": "ratio", "buyVol": "buy", "sellVol": "sell"})


def funding(spark: SparkSession, path: str, service: str, since: Column | None = None) -> DataFrame:
    """symbol, ts, funding_rate; rows before `since` are left out."""
    df = records(spark, path, *FUNDING[service])
    return df if since is None else df.where(F.col("ts") >= since)


def implied(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ts, iv: the closes of a volatility index, as a share."""
    return bars(spark, path, "kline", "$.result.data").select("symbol", "ts", (F.col("close") / 100).alias("iv"))


def span(df: DataFrame) -> DataFrame:
    """symbol, first_ts, last_ts, n, days."""
    return df.groupBy("symbol").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.datediff(F.max("ts"), F.min("ts")).alias("days")
    )


def coverage(sets: dict[str, DataFrame], least: int) -> DataFrame:
    """symbol, a count for each data set, and whether it is FULL in all, PARTIAL or FAILED."""
    every = None
    for n, df in sets.items():
        part = df.select("symbol", F.lit(n).alias("kind"))
        every = part if every is None else every.unionByName(part)
    wide = every.groupBy("symbol").pivot("kind", list(sets)).count().fillna(0)
    full = " AND ".join(f"`{n}` >= {least}" for n in sets)
    some = " OR ".join(f"`{n}` > 0" for n in sets)
    return wide.withColumn("state", F.expr(f"CASE WHEN {full} THEN 'FULL' WHEN {some} THEN 'PARTIAL' ELSE 'FAILED' END"))


def patient(
    get: Callable[[str, dict], tuple[int, object]], url: str, params: dict, tries: int = 5, wait: Callable[[float], None] = time.sleep
) -> object:
    """The body of an answer; a service that is busy (418, 429) or failing is asked again after 1, 2, 4 ... seconds."""
    for k in range(tries):
        status, body = get(url, params)
        if status == 200:
            return body
        if status not in (418, 429) and status < 500:
            raise ValueError(f"{url} answered {status}")
        if k + 1 < tries:
            wait(2.0**k)
    raise TimeoutError(f"{url} stayed busy for {tries} tries")


def paged(
    ask: Callable[[int, int], list], start: int, end: int, size: int, time_of: Callable[[object], int], backward: bool = False, most: int = 400
) -> Iterator[object]:
    """Rows between two times. Forward: from the last row's time on until a page is short. Backward: newest first, until the start or an empty page. `most` pages at most, as services allow."""
    for _ in range(most):
        rows = ask(start, end)
        yield from (r for r in rows if start <= time_of(r) <= end or not backward)
        if not rows or (len(rows) < size and not backward):
            return
        if backward:
            end = min(map(time_of, rows)) - 1
        else:
            start = max(map(time_of, rows)) + 1
        if start > end:
            return


def tick_archives(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ts, price, qty, maker, seq of zipped CSV files, with or without a header, whose columns go by several names. A file is read line by line in one task."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        names = {
            "price": ("price", "p"), "qty": ("quantity", "qty", "q"), "time": ("transact_time", "time", "t"),
            "maker": ("is_buyer_maker", "maker", "m")
        }
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                    head = f.readline().decode().strip().lower().split(",")
                    titled = not head[0].replace(".", "").isdigit()
                    place = {
                        k: next(i for i, h in enumerate(head) if h in v) for k, v in names.items()
                    } if titled else {"price": 1, "qty": 2, "time": 5, "maker": 6}
                    first = [] if titled else [",".join(head)]
                    seq, rows = 0, []
                    for line in itertools.chain(first, map(bytes.decode, f)):
                        cell = line.strip().split(",")
                        if len(cell) > max(place.values()):
                            rows.append(
                                (
                                    file.rsplit("/", 1)[-1].split("-")[0], int(cell[place["time"]]), float(cell[place["price"]]),
                                    float(cell[place["qty"]]), cell[place["maker"]].lower() in ("true", "1"), seq
                                )
                            )
                            seq += 1
                        if len(rows) == 50_000:
                            yield pd.DataFrame(rows, columns=["symbol", "ms", "price", "qty", "maker", "seq"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["symbol", "ms", "price", "qty", "maker", "seq"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    raw = files.mapInPandas(run, "symbol string, ms bigint, price double, qty double, maker boolean, seq bigint")
    return raw.select("symbol", F.timestamp_millis("ms").alias("ts"), "price", "qty", "maker", "seq")
