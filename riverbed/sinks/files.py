"""Results as files: strict JSON, CSV, the book's state, lines for a console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe(df: DataFrame) -> DataFrame:
    """df with null for every number that is not finite: JSON has no words for those."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: clean(v, kind.valueType))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def json_report(df: DataFrame, path: str) -> None:
    """One object a line; times as ISO text in UTC, nulls written out, numbers that are not finite as null."""
    safe(df).write.mode("overwrite").option("ignoreNullFields", False).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A report, or one of other make that holds NaN."""
    return spark.read.schema(schema).option("allowNonNumericNumbers", True).json(path)


def csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def lines(df: DataFrame, order: list[str], most: int = 25) -> list[str]:
    """The first rows in order, as aligned text: a report for people, so the limit is its feature."""
    rows = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in df.orderBy(*order).limit(most).collect()]
    wide = [max(map(len, c)) for c in zip(df.columns, *rows, strict=True)]
    return ["  ".join(v.ljust(n) for v, n in zip(r, wide, strict=True)).rstrip() for r in [df.columns, *rows]]


def write_state(df: DataFrame, path: str) -> None:
    """Positions (instrument, qty, last_px) without those of nothing. A new table is written whole and then takes the old one's place."""
    spark = df.sparkSession
    make = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    df.where(F.abs("qty") > 1e-9).write.mode("overwrite").parquet(f"{path}.next")
    files.delete(make(path), True)
    files.rename(make(f"{path}.next"), make(path))
