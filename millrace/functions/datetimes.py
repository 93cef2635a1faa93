"""Date and time functions of the dialect.

TIME values (negative, above 24 h) are microseconds in BIGINT with a formatter; dates and
datetimes are Spark's DATE and TIMESTAMP_NTZ.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numeric import _c

# Dialect pattern letters and their Java counterparts.
_PATTERNS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%l": "h", "%i": "mm",
    "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%T": "HH:mm:ss", "%r": "hh:mm:ss a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%%": "'%'",
}


def java_pattern(fmt: str) -> str:
    """A dialect format as a Java pattern; letters outside % are quoted."""
    out = []
    for part in re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", fmt):
        out.append(_PATTERNS.get(part, part) if part[0] == "%" else f"'{part}'" if part.isalpha() else part)
    return "".join(out)


def date_format(d, fmt: str) -> Column:
    return F.date_format(_c(d).cast("timestamp"), java_pattern(fmt))


def str_to_date(s, fmt: str) -> Column:
    """Text to TIMESTAMP_NTZ; NULL where the text does not fit."""
    return F.try_to_timestamp(_c(s), F.lit(java_pattern(fmt))).cast("timestamp_ntz")


def add_interval(d, n, unit: str) -> Column:
    """DATE_ADD / ADDDATE: any unit on dates and datetimes, as TIMESTAMP_NTZ."""
    k = unit.upper()
    n = _c(n)
    zero = F.lit(0)
    parts = {"YEAR": 0, "MONTH": 1, "WEEK": 2, "DAY": 3, "HOUR": 4, "MINUTE": 5, "SECOND": 6, "QUARTER": 1}
    args = [zero] * 7
    args[parts[k]] = n * 3 if k == "QUARTER" else n
    return (_c(d).cast("timestamp_ntz") + F.make_interval(*args)).cast("timestamp_ntz")


def time_micros(t) -> Column:
    """'[-][d ]hh:mm:ss[.f]' or 'hhmmss' text to microseconds; NULL if it is no time."""
    t = F.trim(_c(t).cast("string"))
    body = F.regexp_replace(t, "^-", "")
    days = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(body, r"^(\d+) ", 1), F.lit("")), F.lit("999999")), F.lit(0)).cast("long")
    clock = F.regexp_replace(body, r"^\d+ ", "")
    clock = F.when(clock.rlike(r"^\d{6}(\.\d+)?$"), F.regexp_replace(clock, r"^(\d\d)(\d\d)", "$1:$2:")).otherwise(clock)
    n = lambda i: F.regexp_extract(clock, r"^(\d+):(\d{1,2}):(\d{1,2})(?:\.(\d{1,6}))?$", i)
    ok = clock.rlike(r"^\d+:\d{1,2}:\d{1,2}(\.\d{1,6})?$")
    us = ((days * 24 + n(1).cast("long")) * 3600 + n(2).cast("long") * 60 + n(3).cast("long")) * 1_000_000 + F.rpad(n(4), 6, "0").cast("long")
    return F.when(ok, F.when(t.startswith("-"), -us).otherwise(us))


def format_time(us, fraction: bool = False) -> Column:
    """Microseconds to '[-]hh:mm:ss[.ffffff]'."""
    us = _c(us)
    a = F.abs(us)
    s = F.floor(a / 1_000_000)
    pad = lambda x, w=2: F.when(F.length(x.cast("string")) < w, F.lpad(x.cast("string"), w, "0")).otherwise(x.cast("string"))
    out = F.concat(F.when(us < 0, "-").otherwise(""), pad(F.floor(s / 3600)), F.lit(":"), pad(F.floor(s / 60) % 60), F.lit(":"), pad(s % 60))
    return F.concat(out, F.lit("."), pad(a % 1_000_000, 6)) if fraction else out


def cast_time(x) -> Column:
    """CAST(x AS TIME): the time of a datetime, or a time text in its normal form; NULL if it is none."""
    t = _c(x).cast("string")
    clock = F.when(t.rlike(r"^\d{4}-\d\d-\d\d[ T]"), F.substring(t, 12, 15)).otherwise(t)
    return format_time(time_micros(clock))


def curtime() -> Column:
    """CURTIME: the time of day at the start of the query, hh:mm:ss."""
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def sysdate() -> Column:
    """SYSDATE: the instant at which a task reads its first row of a batch, not the start of the query."""

    @F.pandas_udf("timestamp")
    def clock(x: pd.Series) -> pd.Series:
        return pd.Series(pd.Timestamp.now(tz="UTC").tz_localize(None), index=x.index)

    return clock.asNondeterministic()(F.lit(0)).cast("timestamp_ntz")


def sec_to_time(n, fraction: bool = False) -> Column:
    return format_time(F.round(_c(n).cast("decimal(20,6)") * 1_000_000).cast("long"), fraction)


def time_to_sec(t) -> Column:
    return F.floor(time_micros(t) / 1_000_000)


def timediff(a, b) -> Column:
    """Difference of two datetimes as text."""
    us = lambda x: F.unix_micros(_c(x).cast("timestamp"))
    return format_time(us(a) - us(b))


def addtime(d, delta) -> Column:
    """Datetime plus a time text, TIMESTAMP_NTZ."""
    return F.timestamp_micros(F.unix_micros(_c(d).cast("timestamp")) + time_micros(delta)).cast("timestamp_ntz")


def dayname(d) -> Column:
    return F.date_format(_c(d).cast("timestamp"), "EEEE")


def monthname(d) -> Column:
    return F.date_format(_c(d).cast("timestamp"), "MMMM")


def week(d, mode: int = 0) -> Column:
    """WEEK(d, mode).

    Modes 0, 2, 4, 6 start weeks on Sunday, the odd ones on Monday. Modes 2, 3, 6, 7 count days before
    the first week as the last week of the year before (1..53), the others as week 0. In modes 1, 3,
    4, 6 the first week is the one with at least four days in the year, in the others the one that
    holds its first Sunday (Monday).
    """
    d = _c(d).cast("date")
    monday = mode in (1, 3, 5, 7)
    four = mode in (1, 3, 4, 6)
    zero = mode in (0, 1, 4, 5)

    def first(year: Column) -> Column:
        """First day of week 1."""
        jan1 = F.make_date(year, F.lit(1), F.lit(1))
        at = F.weekday(jan1) if monday else F.pmod(F.dayofweek(jan1) - 1, F.lit(7))
        if four:
            return F.when(at <= 3, F.date_sub(jan1, at)).otherwise(F.date_add(jan1, 7 - at))
        return F.when(at == 0, jan1).otherwise(F.date_add(jan1, 7 - at))

    y = F.year(d)
    number = lambda start: (F.floor(F.datediff(d, start) / 7) + 1).cast("int")
    before = F.datediff(d, first(y)) < 0
    if zero:
        return F.when(before, 0).otherwise(number(first(y)))
    over = F.datediff(d, first(y + 1)) >= 0
    return F.when(before, number(first(y - 1))).when(over, number(first(y + 1))).otherwise(number(first(y)))


# Compound units and the parts whose digits they join.
_COMPOUND = {
    "YEAR_MONTH": ("year", "month"), "DAY_HOUR": ("day", "hour"), "DAY_MINUTE": ("day", "hour", "minute"), "DAY_SECOND": ("day", "hour", "minute", "second"),
    "HOUR_MINUTE": ("hour", "minute"), "HOUR_SECOND": ("hour", "minute", "second"), "MINUTE_SECOND": ("minute", "second"),
}


def extract_compound(unit: str, d) -> Column:
    """EXTRACT of a compound unit: two digits for each part after the first."""
    d = _c(d).cast("timestamp")
    out = F.lit(0).cast("long")
    for part in _COMPOUND[unit.upper()]:
        out = out * 100 + getattr(F, part)(d)
    return out


def period_months(p) -> Column:
    """YYMM or YYYYMM as a number of months; two-digit years below 70 are 20xx."""
    p = _c(p).cast("long")
    y = F.floor(p / 100)
    y = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    return (y * 12 + p % 100).cast("long")


def period_diff(a, b) -> Column:
    return period_months(a) - period_months(b)


def to_days(d) -> Column:
    """Days since year 0."""
    return (F.datediff(_c(d).cast("date"), F.lit("1970-01-01").cast("date")) + 719528).cast("int")


def round_seconds(ts) -> Column:
    """Datetime rounded half up to the second."""
    return F.date_trunc("second", _c(ts).cast("timestamp") + F.expr("INTERVAL '0.5' SECOND")).cast("timestamp_ntz")
