"""Date and time functions over order dates and event times."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import datetimes as D
from millrace.plans.registry import Catalogue

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


def _order(name, column, oracle):
    C.add(f"date_{name}", f"SELECT o_orderkey, {oracle} AS v FROM orders")(lambda t: t.orders.select("o_orderkey", column().alias("v")))


def _event(name, column, oracle):
    C.add(f"date_{name}", f"SELECT event_id, {oracle} AS v FROM events")(lambda t: t.events.select("event_id", column().alias("v")))


_order("adddate", lambda: D.add_interval(F.col("o_orderdate"), 31, "DAY"), "o_orderdate + INTERVAL 31 DAY")
_order("add_hours", lambda: D.add_interval(F.to_date(F.col("o_orderdate")), -7, "HOUR"), "CAST(o_orderdate AS DATE) - INTERVAL 7 HOUR")
_order("add_months", lambda: D.add_interval(F.col("o_orderdate"), 1, "MONTH"), "o_orderdate + INTERVAL 1 MONTH")
_order("sub_year", lambda: D.add_interval(F.col("o_orderdate"), -1, "YEAR"), "o_orderdate - INTERVAL 1 YEAR")
_event("addtime", lambda: D.addtime(F.col("ts"), F.lit("1 01:01:01.000002")), "ts + INTERVAL 1 DAY + INTERVAL 1 HOUR + INTERVAL 1 MINUTE + INTERVAL 1 SECOND + INTERVAL 2 MICROSECOND")
_event("timediff", lambda: D.timediff(F.date_trunc("second", F.col("ts").cast("timestamp")), F.lit("2024-01-10").cast("timestamp_ntz")),
       """CASE WHEN date_trunc('second', ts) < TIMESTAMP '2024-01-10' THEN '-' ELSE '' END || CASE WHEN h < 100 THEN lpad(h::VARCHAR, 2, '0') ELSE h::VARCHAR END || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0')""")  # fmt: skip
ORACLES["date_timediff"] = ORACLES["date_timediff"].replace("FROM events", "FROM (SELECT event_id, ts, abs(epoch(date_trunc('second', ts) - TIMESTAMP '2024-01-10'))::BIGINT AS s, abs(epoch(date_trunc('second', ts) - TIMESTAMP '2024-01-10'))::BIGINT // 3600 AS h FROM events)")
_event("date", lambda: F.to_date(F.col("ts")).cast("string"), "CAST(CAST(ts AS DATE) AS VARCHAR)")
_event("time", lambda: F.date_format(F.col("ts"), "HH:mm:ss"), "strftime(ts, '%H:%M:%S')")
_event("timestamp", lambda: F.to_date(F.col("ts")).cast("timestamp_ntz"), "CAST(CAST(ts AS DATE) AS TIMESTAMP)")
_order("year", lambda: F.year(F.col("o_orderdate")), "year(o_orderdate)::INTEGER")
_order("month", lambda: F.month(F.col("o_orderdate")), "month(o_orderdate)::INTEGER")
_order("quarter", lambda: F.quarter(F.col("o_orderdate")), "quarter(o_orderdate)::INTEGER")
_order("day", lambda: F.day(F.col("o_orderdate")), "day(o_orderdate)::INTEGER")
_order("dayofmonth", lambda: F.dayofmonth(F.col("o_orderdate")), "day(o_orderdate)::INTEGER")
_order("dayofyear", lambda: F.dayofyear(F.col("o_orderdate")), "dayofyear(o_orderdate)::INTEGER")
_order("dayname", lambda: D.dayname(F.col("o_orderdate")), "dayname(o_orderdate)")
_order("monthname", lambda: D.monthname(F.col("o_orderdate")), "monthname(o_orderdate)")
_order("weekday", lambda: F.weekday(F.col("o_orderdate")), "(isodow(o_orderdate) - 1)::INTEGER")
_order("dayofweek", lambda: F.dayofweek(F.col("o_orderdate")), "(dayofweek(o_orderdate) + 1)::INTEGER")
_order("weekofyear", lambda: F.weekofyear(F.col("o_orderdate")), "weekofyear(o_orderdate)::INTEGER")
_order("last_day", lambda: F.last_day(F.col("o_orderdate")).cast("string"), "CAST(last_day(o_orderdate) AS VARCHAR)")
_event("hour", lambda: F.hour(F.col("ts")), "hour(ts)::INTEGER")
_event("minute", lambda: F.minute(F.col("ts")), "minute(ts)::INTEGER")
_event("second", lambda: F.second(F.col("ts")), "second(ts)::INTEGER")
_event("microsecond", lambda: (F.unix_micros(F.col("ts").cast("timestamp")) % 1000000).cast("int"), "(epoch_us(ts) % 1000000)::INTEGER")
_event("round_seconds", lambda: D.round_seconds(F.col("ts")), "date_trunc('second', ts + INTERVAL 500 MILLISECOND)")
_event("date_format", lambda: D.date_format(F.col("ts"), "%d/%m/%Y %H.%i"), "strftime(ts, '%d/%m/%Y %H.%M')")
_event("str_to_date", lambda: D.str_to_date(F.date_format(F.col("ts"), "dd.MM.yyyy HH:mm:ss"), "%d.%m.%Y %H:%i:%s"), "date_trunc('second', ts)")
_order("str_to_date_bad", lambda: D.str_to_date("o_orderstatus", "%d.%m.%Y"), "CAST(NULL AS TIMESTAMP)")
_event("unix_timestamp", lambda: F.unix_timestamp(F.col("ts").cast("timestamp")), "CAST(floor(epoch(ts)) AS BIGINT)")
_event("from_unixtime", lambda: F.from_unixtime(F.unix_timestamp(F.col("ts").cast("timestamp"))), "strftime(ts, '%Y-%m-%d %H:%M:%S')")
_order("to_days", lambda: D.to_days(F.col("o_orderdate")), "(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528)::INTEGER")
_order("datediff", lambda: F.datediff(F.col("o_orderdate"), F.lit("1997-03-01").cast("date")), "date_diff('day', DATE '1997-03-01', CAST(o_orderdate AS DATE))::INTEGER")
_event("timestampdiff", lambda: F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")), "date_sub('hour', TIMESTAMP '2024-01-01', ts)")
_event("convert_tz", lambda: F.convert_timezone(F.lit("UTC"), F.lit("+03:30"), F.col("ts")), "ts + INTERVAL 210 MINUTE")
_order("period_diff", lambda: D.period_diff(F.year(F.col("o_orderdate")) * 100 + F.month(F.col("o_orderdate")), F.lit(9002)), "((year(o_orderdate) * 12 + month(o_orderdate)) - (1990 * 12 + 2))::BIGINT")
_order("sec_to_time", lambda: D.sec_to_time(F.lit(50000) - F.col("o_orderkey") % 100000),
       "CASE WHEN n < 0 THEN '-' ELSE '' END || lpad((abs(n) // 3600)::VARCHAR, 2, '0') || ':' || lpad((abs(n) // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((abs(n) % 60)::VARCHAR, 2, '0')")
ORACLES["date_sec_to_time"] = ORACLES["date_sec_to_time"].replace("FROM orders", "FROM (SELECT o_orderkey, 50000 - o_orderkey % 100000 AS n FROM orders)")
_event("time_to_sec", lambda: D.time_to_sec(F.date_format(F.col("ts"), "HH:mm:ss")), "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT")
_order("interval_filter", lambda: (F.col("o_orderdate") >= D.add_interval(F.lit("1997-03-01").cast("date"), -90, "DAY")).cast("int"), "CAST(o_orderdate >= DATE '1997-03-01' - INTERVAL 90 DAY AS INTEGER)")

# EXTRACT of compound units
_Y, _M, _DD, _H, _I, _S = "year(ts)", "month(ts)", "day(ts)", "hour(ts)", "minute(ts)", "second(ts)"
for _unit, _parts in {"year_month": (_Y, _M), "day_hour": (_DD, _H), "day_minute": (_DD, _H, _I), "day_second": (_DD, _H, _I, _S), "hour_minute": (_H, _I), "hour_second": (_H, _I, _S), "minute_second": (_I, _S)}.items():
    _sql = _parts[0]
    for _p in _parts[1:]:
        _sql = f"({_sql}) * 100 + {_p}"
    _event(f"extract_{_unit}", lambda u=_unit: D.extract_compound(u, F.col("ts")), f"CAST({_sql} AS BIGINT)")

# WEEK modes: the first day of week 1 of a year, then whole weeks from it


def _first(monday: bool, four: bool, year: str) -> str:
    jan = f"make_date(({year})::INTEGER, 1, 1)"
    at = f"(isodow({jan}) - 1)" if monday else f"(isodow({jan}) % 7)"
    if four:
        return f"(CASE WHEN {at} <= 3 THEN {jan} - {at}::INTEGER ELSE {jan} + (7 - {at})::INTEGER END)"
    return f"(CASE WHEN {at} = 0 THEN {jan} ELSE {jan} + (7 - {at})::INTEGER END)"


for _mode in range(8):
    _monday, _four, _zero = _mode in (1, 3, 5, 7), _mode in (1, 3, 4, 6), _mode in (0, 1, 4, 5)
    _w = lambda year, m=_monday, f=_four: f"((d - {_first(m, f, year)}) // 7 + 1)"
    _here = _first(_monday, _four, "y")
    if _zero:
        _text = f"CASE WHEN d < {_here} THEN 0 ELSE {_w('y')} END"
    else:
        _text = f"CASE WHEN d < {_here} THEN {_w('y - 1')} WHEN d >= {_first(_monday, _four, 'y + 1')} THEN {_w('y + 1')} ELSE {_w('y')} END"
    _order(f"week_mode_{_mode}", lambda m=_mode: D.week(F.col("o_orderdate"), m), f"({_text})::INTEGER")
    ORACLES[f"date_week_mode_{_mode}"] = ORACLES[f"date_week_mode_{_mode}"].replace("FROM orders", "FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y FROM orders)")


@C.add("date_now", "SELECT r_regionkey, true AS same_day, true AS same_now, true AS same_time FROM region")
def _(t):
    # NOW, CURDATE, CURTIME and CURRENT_TIMESTAMP are one instant for a whole query
    return t.region.select("r_regionkey", (F.to_date(F.now()) == F.curdate()).alias("same_day"), (F.current_timestamp() == F.now()).alias("same_now"), (D.curtime() == F.date_format(F.now(), "HH:mm:ss")).alias("same_time"))


@C.add("date_sysdate", "SELECT r_regionkey, true AS later, true AS soon FROM region")
def _(t):
    # SYSDATE is the clock, which goes on while the query runs
    now = F.now().cast("timestamp_ntz")
    s = t.region.select("r_regionkey", D.sysdate().alias("s"))
    return s.select("r_regionkey", (F.col("s") >= now).alias("later"), (F.col("s") < now + F.expr("INTERVAL 1 HOUR")).alias("soon"))
