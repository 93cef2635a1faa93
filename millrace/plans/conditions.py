"""Conditional functions, casts, JSON, information, network and spatial functions, and UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import aggregate as agg
from millrace.functions import conditional as cond
from millrace.functions import datetimes as D
from millrace.functions import documents as js
from millrace.functions import information as info
from millrace.functions import network as net
from millrace.functions import spatial as sp
from millrace.plans.registry import Catalogue

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


def _row(name, table, key, column, oracle):
    C.add(name, f"SELECT {key}, {oracle} AS v FROM {table}")(lambda t: getattr(t, table).select(key, column().alias("v")))


_row("cond_case", "orders", "o_orderkey", lambda: F.when(F.col("o_totalprice") > 2000, "high").when(F.col("o_totalprice") > 1000, "mid").otherwise("low"), "CASE WHEN o_totalprice > 2000 THEN 'high' WHEN o_totalprice > 1000 THEN 'mid' ELSE 'low' END")
_row("cond_case_simple_predicate", "orders", "o_orderkey", lambda: F.when(F.col("o_custkey") == (F.col("o_custkey") == 1).cast("int"), "same").otherwise("other"), "CASE WHEN o_custkey = CAST(o_custkey = 1 AS INTEGER) THEN 'same' ELSE 'other' END")
_row("cond_case_mixed_types", "orders", "o_orderkey", lambda: F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).otherwise(F.col("o_orderstatus")), "CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) ELSE o_orderstatus END")
_row("cond_if", "orders", "o_orderkey", lambda: cond.if_(F.nullif(F.col("o_orderstatus"), F.lit("P")) == "F", F.lit(1), F.lit(0)), "CASE WHEN nullif(o_orderstatus, 'P') = 'F' THEN 1 ELSE 0 END")
_row("cond_ifnull", "orders", "o_orderkey", lambda: F.ifnull(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("none")), "coalesce(nullif(o_orderstatus, 'P'), 'none')")
_row("cond_isnull", "orders", "o_orderkey", lambda: cond.as_int(F.isnull(F.nullif(F.col("o_orderstatus"), F.lit("P")))), "CAST(nullif(o_orderstatus, 'P') IS NULL AS INTEGER)")
_row("cond_nullif", "orders", "o_orderkey", lambda: F.nullif("o_custkey", F.lit(5).cast("long")), "nullif(o_custkey, 5)")
_row("cond_coalesce", "orders", "o_orderkey", lambda: F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.col("o_custkey").cast("string")), "coalesce(nullif(o_orderstatus, 'P'), CAST(o_custkey AS VARCHAR))")
_row("cast_lenient_prefix", "part", "p_partkey", lambda: cond.lenient_number(F.concat(F.col("p_size").cast("string"), F.lit(".5xyz"))), "p_size + 0.5::DOUBLE")
_row("cast_signed_saturates", "part", "p_partkey", lambda: cond.to_signed(F.concat(F.lit("99999999999999999999"), F.col("p_size").cast("string"))), "9223372036854775807")
_row("cast_signed_no_number", "part", "p_partkey", lambda: cond.to_signed("p_name"), "0::BIGINT")
_row("cast_decimal", "orders", "o_orderkey", lambda: (F.col("o_custkey") / F.lit(8)).cast("decimal(12,3)"), "CAST(o_custkey / 8 AS DECIMAL(12,3))")
_row("cast_char", "orders", "o_orderkey", lambda: F.left(F.col("o_orderkey").cast("string"), F.lit(3)), "left(CAST(o_orderkey AS VARCHAR), 3)")
_row("cast_date", "orders", "o_orderkey", lambda: F.col("o_orderdate").cast("string").try_cast("date").cast("string"), "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)")
_row("cast_unsigned", "orders", "o_orderkey", lambda: cond.to_unsigned(-F.col("o_orderkey")), "CAST(CASE WHEN o_orderkey = 0 THEN 0 ELSE 18446744073709551616::HUGEINT - o_orderkey END AS DECIMAL(20,0))")
_row("default_value", "region", "r_regionkey", lambda: F.coalesce(F.nullif("r_name", F.lit("ASIA")), F.lit("unknown")), "coalesce(nullif(r_name, 'ASIA'), 'unknown')")

_row("json_extract", "events", "event_id", lambda: js.json_extract("props", "$.k").cast("int"), "CAST(json_extract_string(props, '$.k') AS INTEGER)")
_row("json_unquote", "events", "event_id", lambda: js.json_extract("props", "$.k"), "json_extract_string(props, '$.k')")
_row("json_quote", "nation", "n_nationkey", lambda: js.json_quote("n_name"), "'\"' || n_name || '\"'")
_row("json_array", "nation", "n_nationkey", lambda: js.json_array("n_name", F.lit("x")), "'[\"' || n_name || '\",\"x\"]'")
_row("json_contains", "events", "event_id", lambda: js.json_contains("props", '{"k": 87}'), "CAST(json_extract_string(props, '$.k') = '87' AS INTEGER)")
_row("json_set", "events", "event_id", lambda: js.json_extract(js.json_set("props", "$.z", F.col("user_id")), "$.z").cast("long"), "user_id")

_row("net_inet_aton", "orders", "o_orderkey", lambda: net.inet_aton(F.concat(F.lit("10.0."), (F.col("o_custkey") % 256).cast("string"), F.lit("."), (F.col("o_orderkey") % 256).cast("string"))), "167772160 + (o_custkey % 256) * 256 + o_orderkey % 256")
_row("net_inet_ntoa", "orders", "o_orderkey", lambda: net.inet_ntoa(F.col("o_orderkey") + 3232235520), "concat_ws('.', ((o_orderkey + 3232235520) >> 24)::VARCHAR, ((o_orderkey + 3232235520) >> 16 & 255)::VARCHAR, ((o_orderkey + 3232235520) >> 8 & 255)::VARCHAR, ((o_orderkey + 3232235520) & 255)::VARCHAR)")
_row("net_is_ipv4", "part", "p_partkey", lambda: net.is_ipv4(F.concat(F.lit("1.2.3."), (F.col("p_partkey") % 512).cast("string"))), "CAST(p_partkey % 512 < 256 AS INTEGER)")
_row("net_is_ipv6", "part", "p_partkey", lambda: net.is_ipv6(F.concat(F.lit("::"), F.hex("p_size"))), "1")
_row("net_inet6_aton", "part", "p_partkey", lambda: F.hex(net.inet6_aton(F.concat(F.lit("2001:db8::"), F.lower(F.hex("p_size"))))), "'20010DB8' || repeat('0', 16) || lpad(upper(printf('%x', p_size)), 8, '0')")
_row("net_inet6_ntoa", "part", "p_partkey", lambda: net.inet6_ntoa(F.unhex(F.concat(F.lit("FE80"), F.repeat(F.lit("0"), 24), F.lpad(F.hex(F.col("p_size") + 1), 4, "0")))), "'fe80::' || printf('%x', p_size + 1)")
_row("net_is_ipv6_mixed", "part", "p_partkey", lambda: net.is_ipv6(F.when(F.col("p_size") > 25, F.concat(F.lit("::"), F.hex("p_size"))).when(F.col("p_size") > 10, "1.2.3.4").otherwise(F.col("p_name"))), "CAST(p_size > 25 AS INTEGER)")
_row("json_set_array", "events", "event_id", lambda: js.json_extract(js.json_set(F.concat(F.lit("[1,["), F.col("user_id").cast("string"), F.lit("]]")), "$[1][1]", F.col("event_id")), "$[1]"), "'[' || user_id || ',' || event_id || ']'")
_row("cast_time", "events", "event_id", lambda: D.cast_time(F.col("ts").cast("string")), "strftime(ts, '%H:%M:%S')")
_row("cast_time_text", "part", "p_partkey", lambda: D.cast_time(F.concat(F.lit("-"), (F.col("p_size") * 3).cast("string"), F.lit(":5:7"))), "'-' || CASE WHEN p_size * 3 < 100 THEN lpad(CAST(p_size * 3 AS VARCHAR), 2, '0') ELSE CAST(p_size * 3 AS VARCHAR) END || ':05:07'")
_row("cast_date_bad", "orders", "o_orderkey", lambda: F.concat(F.lit("2024-02-"), (F.col("o_custkey") % 40).cast("string")).try_cast("date").cast("string"), "CASE WHEN o_custkey % 40 BETWEEN 1 AND 29 THEN '2024-02-' || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') END")
_row("net_inet6_roundtrip", "part", "p_partkey", lambda: net.inet6_ntoa(net.inet6_aton(F.concat(F.lit("2001:db8::"), F.lower(F.hex("p_size"))))), "'2001:db8::' || printf('%x', p_size)")


@C.add("info_functions", "SELECT 'utf8' AS cs, 'binary' AS cs_number, 'UTF8_BINARY' AS coll, 'UTF8_LCASE' AS coll_ci, 'default' AS db, true AS same_user, true AS has_version, true AS new_uuid")
def _(t):
    text = F.lit("a")
    return t.spark.range(1).select(
        info.charset(text).alias("cs"), info.charset(F.lit(1)).alias("cs_number"), info.collation(text).alias("coll"), info.collation(F.collate(text, "UTF8_LCASE")).alias("coll_ci"), info.database().alias("db"),
        ((F.current_user() == F.session_user()) & (F.length(F.user()) > 0)).alias("same_user"), F.version().startswith(t.spark.version).alias("has_version"), (F.uuid() != F.uuid()).alias("new_uuid"),
    )


@C.add("spatial_functions", "SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y, CAST(p_size > 10 AND p_size < 30 AND p_retailprice > 900 AND p_retailprice < 1400 AS INTEGER) AS inside FROM part")
def _(t):
    p = sp.point("p_size", "p_retailprice")
    ring = sp.polygon_from_text(F.lit("POLYGON((10 900, 30 900, 30 1400, 10 1400, 10 900))"))[0]
    return t.part.select("p_partkey", sp.st_x(p).alias("x"), sp.st_y(p).alias("y"), sp.st_within(p, ring).alias("inside"))


@C.add("spatial_contains_hole", "SELECT p_partkey, CAST(p_size > 10 AND p_size < 40 AND p_retailprice > 900 AND p_retailprice < 1400 AND NOT (p_size BETWEEN 20 AND 30 AND p_retailprice BETWEEN 950 AND 1200) AS INTEGER) AS inside FROM part")
def _(t):
    # a polygon with a hole; borders of both rings are outside
    shape = sp.polygon_from_text(F.lit("POLYGON((10 900, 40 900, 40 1400, 10 1400, 10 900), (20 950, 30 950, 30 1200, 20 1200, 20 950))"))
    return t.part.select("p_partkey", sp.st_contains(shape, sp.point("p_size", "p_retailprice")).alias("inside"))


@C.add("spatial_line_text", "SELECT p_partkey, 'LINESTRING(0 0,' || p_size || ' ' || (p_size * 2) || ')' AS wkt, CAST(p_size >= 20 AS INTEGER) AS on_line FROM part")
def _(t):
    line = sp.line_from_text(F.concat(F.lit("LINESTRING(0 0, "), F.col("p_size").cast("string"), F.lit(" "), (F.col("p_size") * 2).cast("string"), F.lit(")")))
    return t.part.select("p_partkey", sp.line_as_text(line).alias("wkt"), sp.st_on_line(sp.point(F.lit(20), F.lit(40)), line).alias("on_line"))


@C.add("spatial_text", "SELECT p_partkey, 'POINT(' || p_size || ' ' || (p_size + 1) || ')' AS wkt FROM part")
def _(t):
    text = F.concat(F.lit("POINT("), F.col("p_size").cast("string"), F.lit(" "), (F.col("p_size") + 1).cast("string"), F.lit(")"))
    return t.part.select("p_partkey", sp.point_as_text(sp.point_from_text(text)).alias("wkt"))


@C.add("spatial_mbr", "SELECT p_partkey, CAST(p_size <= 20 AS INTEGER) AS w, CAST(p_size >= 20 AS INTEGER) AS c, CAST(p_size = 20 AS INTEGER) AS e FROM part")
def _(t):
    box = lambda n: sp.mbr(sp.linestring(sp.point(F.lit(0), F.lit(0)), sp.point(n, n)))
    a, b = box(F.col("p_size")), box(F.lit(20))
    return t.part.select("p_partkey", sp.mbr_within(a, b).alias("w"), sp.mbr_contains(a, b).alias("c"), sp.mbr_equals(a, b).alias("e"))


@C.add("udf_square", "SELECT p_partkey, pow(p_size, 2)::DOUBLE AS v FROM part")
def _(t):
    @F.pandas_udf("double")
    def square(x: pd.Series) -> pd.Series:
        return x.astype(float) ** 2

    return t.part.select("p_partkey", square("p_size").alias("v"))


@C.add("udf_sql_function", "SELECT n_nationkey, n_nationkey * n_nationkey + 1 AS v FROM nation")
def _(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION millrace_square_plus(n INT, m INT) RETURNS INT RETURN n * n + m")
    t.nation.createOrReplaceTempView("nation")
    return t.spark.sql("SELECT n_nationkey, millrace_square_plus(n_nationkey, 1) AS v FROM nation")


@C.add("udf_lookup", "SELECT n_nationkey, coalesce(r_name, 'none') AS v FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def _(t):
    # a function with a subquery inside is a join against its lookup table
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.coalesce("r_name", F.lit("none")).alias("v"))


@C.add("udaf_avgcost", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS v FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(agg.avg_cost("l_extendedprice", "l_quantity"), 4).alias("v"))


@C.add("udaf_median", "SELECT l_returnflag, median(l_quantity) AS v FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(agg.median_("l_quantity").alias("v"))


@C.add("prepared_args", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1500")
def _(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = :s AND o_totalprice > :p", args={"s": "P", "p": 1500})


@C.add("explain_plan", "SELECT 'pushed filter' AS fact UNION ALL SELECT 'columns read' UNION ALL SELECT 'exchange' UNION ALL SELECT 'codegen'")
def _(t):
    # the lines of a formatted plan are rows; here those that show what the scan does
    q = t.lineitem.where("l_quantity > 49").groupBy("l_returnflag").count()
    text = q._sc._jvm.PythonSQLUtils.explainString(q._jdf.queryExecution(), "formatted")
    plan = t.spark.createDataFrame([(line,) for line in text.splitlines()], "line string")
    facts = {"pushed filter": "PushedFilters: .*GreaterThan.l_quantity,49.0", "columns read": "ReadSchema: struct<l_quantity:double,l_returnflag:string>$", "exchange": "hashpartitioning.l_returnflag", "codegen": "HashAggregate"}
    fact = F.lit(None).cast("string")
    for name, pattern in facts.items():
        fact = F.when(F.col("line").rlike(pattern), name).otherwise(fact)
    return plan.select(fact.alias("fact")).where("fact IS NOT NULL").distinct()


@C.add("show_tables", "SELECT 'nation' AS name UNION ALL SELECT 'region'")
def _(t):
    t.nation.createOrReplaceTempView("nation")
    t.region.createOrReplaceTempView("region")
    return t.spark.sql("SHOW TABLES").where("tableName IN ('nation', 'region')").select(F.col("tableName").alias("name"))
