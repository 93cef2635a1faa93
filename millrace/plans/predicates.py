"""Projections, filters, predicates and scalar subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import conditional as cond
from millrace.functions import numeric as num
from millrace.operators import relational as rel
from millrace.plans.registry import Catalogue

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles
KEY = ["l_orderkey", "l_linenumber"]
_K = "l_orderkey, l_linenumber"


@C.add("project_arith", f"SELECT {_K}, l_quantity + 1 AS a, round(l_quantity / 10.3, 6) AS b, l_partkey * 2 - l_suppkey AS c FROM lineitem")
def _(t):
    return t.lineitem.select(*KEY, (F.col("l_quantity") + 1).alias("a"), F.round(F.col("l_quantity") / 10.3, 6).alias("b"), (F.col("l_partkey") * 2 - F.col("l_suppkey")).alias("c"))


@C.add("filter_and_or_not", f"SELECT {_K} FROM lineitem WHERE (l_returnflag = 'A' OR l_quantity > 45) AND NOT (l_linestatus = 'O' AND l_discount < 0.02)")
def _(t):
    a, q = F.col("l_returnflag") == "A", F.col("l_quantity") > 45
    return t.lineitem.where((a | q) & ~((F.col("l_linestatus") == "O") & (F.col("l_discount") < 0.02))).select(*KEY)


@C.add("filter_xor", f"SELECT {_K} FROM lineitem WHERE (l_returnflag = 'A') <> (l_quantity > 25)")
def _(t):
    return t.lineitem.where(cond.xor(F.col("l_returnflag") == "A", F.col("l_quantity") > 25)).select(*KEY)


@C.add("null_or_true", f"SELECT {_K}, CAST((nullif(l_returnflag, 'N') = 'A' OR l_quantity > 25) AS INTEGER) AS p, CAST((nullif(l_returnflag, 'N') = 'A' AND l_quantity > 25) AS INTEGER) AS q FROM lineitem")
def _(t):
    a, b = F.nullif("l_returnflag", F.lit("N")) == "A", F.col("l_quantity") > 25
    return t.lineitem.select(*KEY, cond.as_int(a | b).alias("p"), cond.as_int(a & b).alias("q"))


@C.add("int_as_bool", "SELECT o_orderkey FROM orders WHERE (o_custkey % 3) <> 0 AND ((o_orderkey % 2) <> 0 OR false)")
def _(t):
    return t.orders.where(cond.truth(F.col("o_custkey") % 3) & (cond.truth(F.col("o_orderkey") % 2) | cond.truth(F.lit(0)))).select("o_orderkey")


@C.add("compare_beyond_bigint", "SELECT o_orderkey FROM orders WHERE o_orderkey < 10")
def _(t):
    # a literal above 2^63 is compared exactly, as a decimal
    return t.orders.where((F.col("o_orderkey").cast("decimal(20,0)") < F.lit("18446744073709551601").cast("decimal(20,0)")) & (F.col("o_orderkey") < 10)).select("o_orderkey")


@C.add("null_safe_eq", f"SELECT {_K}, CAST((nullif(l_returnflag, 'N') IS NOT DISTINCT FROM nullif(l_linestatus, 'F')) AS INTEGER) AS same FROM lineitem")
def _(t):
    return t.lineitem.select(*KEY, cond.as_int(F.nullif("l_returnflag", F.lit("N")).eqNullSafe(F.nullif("l_linestatus", F.lit("F")))).alias("same"))


@C.add("between", f"SELECT {_K} FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01'")
def _(t):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.lineitem.where(F.col("l_quantity").between(10, 20) & F.col("l_shipdate").between(ts("1996-01-01"), ts("1997-01-01"))).select(*KEY)


C.sql("not_between", "lineitem", f"SELECT {_K} FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45")
C.sql("between_reversed", "lineitem", f"SELECT {_K} FROM lineitem WHERE l_quantity BETWEEN 45 AND 5")
C.sql("between_as_number", "orders", "SELECT o_orderkey, CAST((o_custkey BETWEEN 10 AND 50) AS INT) AS inside FROM orders")


@C.add("in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 15, -3)")
def _(t):
    return t.part.where(F.col("p_size").isin(1, 7, 15, -3)).select("p_partkey")


C.sql("not_in_list_null", "part", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, NULL)")
C.sql("in_list_null", "part", "SELECT p_partkey, CAST((p_size IN (1, NULL)) AS INT) AS hit FROM part")
C.sql("like", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%a_'")
C.sql("not_like", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT LIKE 'B%'")


@C.add("like_escape", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1|-%' ESCAPE '|'")
def _(t):
    return t.orders.where(F.like("o_orderpriority", F.lit("1-%"), F.lit("|"))).select("o_orderkey")


C.sql("like_column_pattern", "customer", "SELECT c_custkey FROM customer WHERE c_name LIKE concat('%', CAST(c_nationkey AS STRING), '%')", "SELECT c_custkey FROM customer WHERE c_name LIKE concat('%', CAST(c_nationkey AS VARCHAR), '%')")


@C.add("rlike", "SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[1-3]-.*(GENT|IGH)$')")
def _(t):
    return t.orders.where(F.col("o_orderpriority").rlike("^[1-3]-.*(GENT|IGH)$")).select("o_orderkey")


@C.add("is_null", "SELECT doc_id FROM documents WHERE text IS NULL")
def _(t):
    return t.documents.where(F.col("text").isNull()).select("doc_id")


@C.add("empty_is_not_null", "SELECT count(*) FILTER (WHERE text IS NULL) AS nulls, count(*) FILTER (WHERE text = '') AS empty, count(text) AS n FROM documents")
def _(t):
    return t.documents.agg(F.count_if(F.col("text").isNull()).alias("nulls"), F.count_if(F.col("text") == "").alias("empty"), F.count("text").alias("n"))


C.sql("is_true", "lineitem", f"SELECT {_K}, CAST(((nullif(l_returnflag, 'N') = 'A') IS TRUE) AS INT) AS t, CAST(((nullif(l_returnflag, 'N') = 'A') IS NOT TRUE) AS INT) AS f FROM lineitem")

@C.add("row_compare", "SELECT n_nationkey FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 3) AND n_regionkey = 3")
def _(t):
    top = t.nation.where("n_regionkey = 3").agg(F.max("n_nationkey").alias("a")).select("a", F.lit(3).alias("b"))
    return t.nation.join(F.broadcast(top), F.struct("n_nationkey", "n_regionkey") == F.struct("a", "b"), "left_semi").select("n_nationkey")


@C.add("bit_ops", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 255 AS o, xor(o_orderkey, 255) AS x, CAST(18446744073709551615::HUGEINT - o_orderkey AS DECIMAL(20,0)) AS n FROM orders")
def _(t):
    k = F.col("o_orderkey")
    b = F.lit(255).cast("long")
    return t.orders.select("o_orderkey", k.bitwiseAND(b).alias("a"), k.bitwiseOR(b).alias("o"), k.bitwiseXOR(b).alias("x"), num.bit_not(k).alias("n"))


@C.add("shift_guard", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey * 3 >= 64 THEN 0 ELSE pow(2::HUGEINT, n_nationkey * 3) END AS DECIMAL(20,0)) AS l, CAST(CASE WHEN n_nationkey * 3 >= 64 THEN 0 ELSE 18446744073709551615::HUGEINT >> (n_nationkey * 3) END AS DECIMAL(20,0)) AS r FROM nation")
def _(t):
    n = F.col("n_nationkey") * 3
    return t.nation.select("n_nationkey", num.shift_left(F.lit(1), n).alias("l"), num.shift_right(F.lit(-1), n).alias("r"))


@C.add("div_zero_null", f"SELECT {_K}, CASE WHEN l_linenumber - 1 = 0 THEN NULL ELSE round(l_quantity / (l_linenumber - 1), 6) END AS q FROM lineitem")
def _(t):
    return t.lineitem.select(*KEY, F.round(num.divide("l_quantity", F.col("l_linenumber") - 1), 6).alias("q"))


@C.add("div_exact", "SELECT o_orderkey, CAST(round(CAST(o_custkey AS DECIMAL(20,4)) / 7, 4) AS DECIMAL(24,4)) AS q FROM orders")
def _(t):
    return t.orders.select("o_orderkey", num.divide_exact("o_custkey", 7).alias("q"))


@C.add("int_div", f"SELECT {_K}, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(trunc(CAST(l_partkey AS DECIMAL(18,3)) / (l_linenumber - 3)) AS BIGINT) END AS q FROM lineitem")
def _(t):
    return t.lineitem.select(*KEY, num.int_div("l_partkey", F.col("l_linenumber") - 3).alias("q"))


@C.add("mod_zero_null", f"SELECT {_K}, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_partkey % (l_linenumber - 3) END AS r FROM lineitem")
def _(t):
    return t.lineitem.select(*KEY, num.modulo("l_partkey", (F.col("l_linenumber") - 3).cast("long")).alias("r"))


C.sql("unary_minus_not", "orders", "SELECT o_orderkey, -(o_custkey + 1) * -2 AS m, CAST((o_custkey % 2 = 0) AS INT) AS no FROM orders")

@C.add("scalar_subquery_select", "SELECT n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def _(t):
    # a correlated scalar subquery on a unique key is a left join
    return t.nation.join(rel.small(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")


C.sql("scalar_subquery_where", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
C.sql("correlated_scalar_max", "orders", "SELECT o_orderkey, o_custkey FROM orders a WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)")


@C.add("fulltext_boolean", "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'red') AND NOT list_contains(string_split(lower(p_name), ' '), 'small')")
def _(t):
    return rel.match_against(t.part, "p_name", "+red -small").select("p_partkey")


@C.add("char_trailing_blanks", "SELECT c_custkey FROM customer WHERE rtrim(c_mktsegment || '  ') = 'BUILDING'")
def _(t):
    from millrace.functions.strings import equal_char

    return t.customer.where(equal_char(F.concat("c_mktsegment", F.lit("  ")), F.lit("BUILDING"))).select("c_custkey")


@C.add("collation_ci", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(t):
    return t.customer.where(F.expr("c_mktsegment COLLATE UTF8_LCASE = 'building'")).select("c_custkey")


@C.add("bool_as_int", "SELECT o_orderkey, CAST(o_totalprice > 1000 AS INTEGER) AS p FROM orders")
def _(t):
    return t.orders.select("o_orderkey", cond.as_int(F.col("o_totalprice") > 1000).alias("p"))


@C.add("spatial_bbox", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 1500")
def _(t):
    from millrace.functions import spatial as sp

    p = sp.point("p_size", "p_retailprice")
    box = sp.mbr(F.array(sp.point(F.lit(10), F.lit(900)), sp.point(F.lit(20), F.lit(1500))))
    return t.part.where(sp.mbr_within(sp.mbr(F.array(p)), box) == 1).select("p_partkey")


@C.add("fulltext_phrase_prefix", "SELECT p_partkey, CAST(p_name LIKE '% widget' AS INTEGER) + CAST(p_name LIKE 'red %' AS INTEGER) AS relevance FROM part WHERE (p_name LIKE 'red widget' OR p_name LIKE '% widget' OR p_name LIKE 'red %') AND p_name NOT LIKE '%ring'")
def _(t):
    # words by their beginning, a word that must not occur, and the best rows first
    return rel.match_against(t.part, "p_name", "widg* red -ring", ranked=True).select("p_partkey", "relevance")


@C.add("fulltext_phrase", "SELECT p_partkey FROM part WHERE p_name = 'red widget'")
def _(t):
    return rel.match_against(t.part, "p_name", '+"red widget"').select("p_partkey")
