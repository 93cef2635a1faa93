"""Golden values of the dialect."""

import datetime as dt
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from millrace.functions import aggregate as agg
from millrace.functions import conditional as cond
from millrace.functions import datetimes as d
from millrace.functions import documents as js
from millrace.functions import information as info
from millrace.functions import network as net
from millrace.functions import numeric as num
from millrace.functions import spatial as sp
from millrace.functions import strings as s
from millrace.functions.names import plain

L = F.lit
GOLDEN = {
    "20 DIV 2.4": (lambda: num.int_div(L(20), L(Dec("2.4"))), 8),
    "24 DIV 4.7": (lambda: num.int_div(L(24), L(Dec("4.7"))), 5),
    "1234.567 DIV 2.4": (lambda: num.int_div(L(Dec("1234.567")), L(Dec("2.4"))), 514),
    "-7 DIV 2": (lambda: num.int_div(L(-7), L(2)), -3),
    "10 DIV 0": (lambda: num.int_div(L(10), L(0)), None),
    "8/5": (lambda: num.divide_exact(L(8), L(5)), Dec("1.6000")),
    "8/0": (lambda: num.divide(L(8), L(0)), None),
    "8%5": (lambda: num.modulo(L(8), L(5)), 3),
    "8%0": (lambda: num.modulo(L(8), L(0)), None),
    "1<<63": (lambda: num.shift_left(L(1), L(63)), Dec("9223372036854775808")),
    "1<<64": (lambda: num.shift_left(L(1), L(64)), Dec(0)),
    "4>>63": (lambda: num.shift_right(L(4), L(63)), Dec(0)),
    "-1>>1": (lambda: num.shift_right(L(-1), L(1)), Dec("9223372036854775807")),
    "~0": (lambda: num.bit_not(L(0)), Dec("18446744073709551615")),
    "unsigned -123": (lambda: cond.to_unsigned(L(-123)), Dec("18446744073709551493")),
    "round 35.498,-1": (lambda: F.round(L(Dec("35.498")), -1).cast("int"), 40),
    "round -21.5": (lambda: F.round(L(Dec("-21.5"))).cast("int"), -22),
    "truncate decimal": (lambda: num.truncate_exact(L(Dec("4.35")), 2), Dec("4.35")),
    "truncate decimal down": (lambda: num.truncate_exact(L(Dec("-4.359")), 2), Dec("-4.35")),
    "truncate integer": (lambda: num.truncate_exact(L(-1289), -2).cast("long"), -1200),
    "json_set position": (lambda: js.json_set(L('{"a":[1,2]}'), "$.a[0]", L(9)), '{"a": [9, 2]}'),
    "json_set array document": (lambda: js.json_set(L("[1,2]"), "$[1]", L(9)), "[1, 9]"),
    "json_set behind the end": (lambda: js.json_set(L('{"a":[1]}'), "$.a[7]", L(9)), '{"a": [1, 9]}'),
    "json_set below a position": (lambda: js.json_set(L('{"a":[{"b":1}]}'), "$.a[0].c", L("x")), '{"a": [{"b": 1, "c": "x"}]}'),
    "json_set through a number": (lambda: js.json_set(L('{"a":1}'), "$.a.c", L(9)), '{"a": 1}'),
    "json_set single value": (lambda: js.json_set(L('{"a":1}'), "$.a[1]", L(9)), '{"a": [1, 9]}'),
    "json_set quoted name": (lambda: js.json_set(L("{}"), '$."k.l"', L(9)), '{"k.l": 9}'),
    "soundex": (lambda: s.soundex(L("Quadratically")), "Q36324"),
    "soundex short": (lambda: s.soundex(L("Hello")), "H400"),
    "soundex none": (lambda: s.soundex(L("12")), ""),
    "cast time": (lambda: d.cast_time(L("2024-01-02 03:04:05.9")), "03:04:05"),
    "cast time text": (lambda: d.cast_time(L("101:2:3")), "101:02:03"),
    "cast no time": (lambda: d.cast_time(L("x")), None),
    "charset": (lambda: info.charset(L("a")), "utf8"),
    "database": (lambda: info.database(), "default"),
    "border is outside": (lambda: sp.st_within(sp.point(L(0), L(5)), sp.polygon_from_text(L("POLYGON((0 0,10 0,10 10,0 10,0 0))"))[0]), 0),
    "hole is outside": (lambda: sp.st_contains(sp.polygon_from_text(L("POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))")), sp.point(L(5), L(5))), 0),
    "inside": (lambda: sp.st_contains(sp.polygon_from_text(L("POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))")), sp.point(L(1), L(5))), 1),
    "truncate": (lambda: num.truncate(L(-1.999), 1), -1.9),
    "greatest null": (lambda: num.greatest_strict(L(1), L(None).cast("int")), None),
    "zerofill": (lambda: num.zerofill(L(42), 5), "00042"),
    "mid -5": (lambda: s.mid(L("quarry engine"), L(-5), L(15)), "ngine"),
    "mid -15": (lambda: s.mid(L("quarry engine"), L(-15), L(15)), ""),
    "mid 0": (lambda: s.mid(L("abc"), L(0), L(1)), ""),
    "left -1": (lambda: s.left(L("abc"), L(-1)), ""),
    "strcmp": (lambda: s.strcmp(L("a"), L("b")), -1),
    "insert": (lambda: s.insert(L("Quadratic"), L(3), L(4), L("What")), "QuWhattic"),
    "insert outside": (lambda: s.insert(L("Quadratic"), L(-1), L(4), L("What")), "Quadratic"),
    "insert long": (lambda: s.insert(L("Quadratic"), L(3), L(100), L("What")), "QuWhat"),
    "ord": (lambda: s.ord_(L("é")), 0xC3A9),
    "ord empty": (lambda: s.ord_(L("")), 0),
    "char blanks": (lambda: s.equal_char(L(""), L(" ")), True),
    "gbk": (lambda: F.hex(s.gbk_bytes(L("中"))), "D6D0"),
    "ascii 0": (lambda: F.ascii(L("0")), 48),
    "md5": (lambda: F.md5(L("")), "d41d8cd98f00b204e9800998ecf8427e"),
    "conv": (lambda: F.conv(L("2011"), 10, 16), "7DB"),
    "plain": (lambda: plain(L("  ##@ Big Tag ")), "big tag"),
    "dayname": (lambda: d.dayname(L("2020-12-22").cast("date")), "Tuesday"),
    "week 0": (lambda: d.week(L("2008-02-20").cast("date"), 0), 7),
    "week 1": (lambda: d.week(L("2008-02-20").cast("date"), 1), 8),
    "week 1 end": (lambda: d.week(L("2008-12-31").cast("date"), 1), 53),
    "week 0 start": (lambda: d.week(L("2000-01-01").cast("date"), 0), 0),
    "week 2 start": (lambda: d.week(L("2000-01-01").cast("date"), 2), 52),
    "year_month": (lambda: d.extract_compound("YEAR_MONTH", L("2019-07-02 01:02:03").cast("timestamp")), 201907),
    "day_minute": (lambda: d.extract_compound("DAY_MINUTE", L("2019-07-02 01:02:03").cast("timestamp")), 20102),
    "period_diff": (lambda: d.period_diff(L(201808), L(199508)), 276),
    "period_diff short": (lambda: d.period_diff(L(1602), L(9002)), 312),
    "sec_to_time": (lambda: d.sec_to_time(L(-1000000), True), "-277:46:40.000000"),
    "time digits": (lambda: d.format_time(d.time_micros(L("112233"))), "11:22:33"),
    "time days": (lambda: d.format_time(d.time_micros(L("-1 01:00:00.5")), True), "-25:00:00.500000"),
    "time bad": (lambda: d.time_micros(L("x")), None),
    "addtime": (lambda: d.addtime(L("2007-12-31 23:59:59").cast("timestamp_ntz"), L("1 1:1:1.000002")), dt.datetime(2008, 1, 2, 1, 1, 0, 2)),
    "timediff": (lambda: d.timediff(L("2000-01-01 00:00:00").cast("timestamp_ntz"), L("2000-01-03 00:00:01").cast("timestamp_ntz")), "-48:00:01"),
    "str_to_date": (lambda: d.str_to_date(L("01,5,2013"), "%d,%c,%Y"), dt.datetime(2013, 5, 1)),
    "str_to_date bad": (lambda: d.str_to_date(L("x"), "%d"), None),
    "to_days": (lambda: d.to_days(L("2007-10-07").cast("date")), 733321),
    "adddate hours": (lambda: d.add_interval(L("2020-01-01").cast("date"), L(-1), "HOUR"), dt.datetime(2019, 12, 31, 23)),
    "round seconds": (lambda: d.round_seconds(L("2001-01-01 23:59:59.65").cast("timestamp_ntz")), dt.datetime(2001, 1, 2)),
    "if null": (lambda: cond.if_(L(None).cast("boolean"), L(1), L(2)), 2),
    "lenient": (lambda: cond.lenient_number(L("12.5abc")), 12.5),
    "lenient none": (lambda: cond.lenient_number(L("abc")), 0.0),
    "signed": (lambda: cond.to_signed(L("18000000000000000000")), 9223372036854775807),
    "json order": (lambda: js.json_contains(L("[2, 1]"), "[1, 2]"), 1),
    "json missing": (lambda: js.json_contains(L("[2, 1]"), "[1, 0, 2]"), 0),
    "json object": (lambda: js.json_contains(L('{"a": 1, "b": {"c": [1, 2]}}'), '{"b": {"c": 2}}'), 1),
    "json bad": (lambda: js.json_contains(L("{"), "1"), None),
    "json quote": (lambda: js.json_quote(L('a"b')), '"a\\"b"'),
    "json set": (lambda: js.json_set(L('{"a": 1}'), "$.b.c", L(2)), '{"a": 1, "b": {"c": 2}}'),
    "inet_aton": (lambda: net.inet_aton(L("10.0.5.9")), 167773449),
    "inet_aton bad": (lambda: net.inet_aton(L("10.0.5.256")), None),
    "inet_ntoa": (lambda: net.inet_ntoa(L(167773449)), "10.0.5.9"),
    "inet6": (lambda: net.inet6_ntoa(net.inet6_aton(L("2001:DB8::1"))), "2001:db8::1"),
    "is_ipv6": (lambda: net.is_ipv6(L("10.0.0.1")), 0),
    "within": (lambda: sp.st_within(sp.point_from_text(L("POINT(1 1)")), sp.polygon_from_text(L("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"))[0]), 1),
    "outside": (lambda: sp.st_within(sp.point(L(3), L(1)), sp.polygon_from_text(L("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"))[0]), 0),
    "as text": (lambda: sp.point_as_text(sp.point(L(1), L(2.5))), "POINT(1 2.5)"),
    "no point": (lambda: sp.point_from_text(L("POINT()")), None),
}


@pytest.fixture(scope="module")
def values(spark):
    return spark.range(1).select(*[f().alias(str(i)) for i, (f, _) in enumerate(GOLDEN.values())]).first()


@pytest.mark.parametrize("i", range(len(GOLDEN)), ids=list(GOLDEN))
def test_golden(values, i):
    want = list(GOLDEN.values())[i][1]
    assert values[i] == (pytest.approx(want) if isinstance(want, float) else want)


def test_null_safe_and_three_valued(spark):
    r = spark.sql("SELECT CAST(NULL <=> NULL AS INT) a, CAST(0 <=> NULL AS INT) b, CAST(NULL OR true AS INT) c, CAST(NULL AND true AS INT) d").first()
    assert tuple(r) == (1, 0, 1, None)


def test_aggregates(spark):
    df = spark.createDataFrame([(None, ""), (1, "aaa"), (2, "aaa"), (1, "ccc"), (4, "ddd"), (5, "aaa"), (6, "ddd"), (7, "eee")], "a int, b string")
    r = df.selectExpr("round(avg(DISTINCT a), 4) x", "round(avg(a), 4) y").first()
    assert tuple(r) == (4.1667, 3.7143)
    g = df.groupBy("b").agg(agg.group_concat("a").alias("v"), agg.group_concat("a", ":", descending=True, distinct=True).alias("w"), agg.group_concat("b", order="a").alias("o"))
    assert {r.b: (r.v, r.w) for r in g.collect()} == {"": (None, None), "aaa": ("1,2,5", "5:2:1"), "ccc": ("1", "1"), "ddd": ("4,6", "6:4"), "eee": ("7", "7")}
    assert df.where("a > 99").agg(agg.group_concat("a").alias("v")).first().v is None
    assert df.agg(agg.avg_cost("a", L(0)).alias("v")).first().v is None
