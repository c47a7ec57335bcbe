"""Symbols, codes and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The quote that symbols end in, and the letters of delivery months.
QUOTE = "USDT"
MONTHS = "FGHJKMNQUVXZ"


def normalized(name: Column) -> Column:
    """Upper case without / - _ and blanks, ending in the quote."""
    s = F.upper(F.regexp_replace(name, "[/_ -]", ""))
    return F.when(s.endswith(QUOTE), s).otherwise(F.concat(s, F.lit(QUOTE)))


def coin(symbol: Column) -> Column:
    """What stands before the quote."""
    return F.regexp_replace(symbol, f"{QUOTE}$", "")


def flagged(symbol: Column, parts: tuple[str, ...]) -> Column:
    """Whether any of the parts occurs."""
    return symbol.rlike("|".join(parts))


def expiry(code: Column) -> Column:
    """The date of a code yyMMdd, from 1970 to 2069."""
    return F.to_date(F.concat(F.when(code >= "70", F.lit("19")).otherwise(F.lit("20")), code), "yyyyMMdd")


def month_code(code: Column) -> Column:
    """The first day of a delivery month written as letter and two digits of the year; null for other codes."""
    month = F.instr(F.lit(MONTHS), F.substring(code, 1, 1))
    return F.when(code.rlike(f"^[{MONTHS}][0-9]{{2}}$"), F.make_date(2000 + F.substring(code, 2, 2).cast("int"), month, F.lit(1)))


def numbers(listed: Column, kind: str = "double") -> Column:
    """The numbers of a list with commas; what is none is dropped."""
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x).try_cast(kind)), lambda x: x.isNotNull())


def utc(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def tag(*parts: Column) -> Column:
    """The name of a cached file: sixteen hexadecimal digits of the parts' hash."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)
