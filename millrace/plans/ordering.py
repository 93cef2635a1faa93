"""Sorting, limits, set operations, and windows that stand for user variables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import numbering
from millrace.operators import relational as rel
from millrace.operators.groups import along
from millrace.plans.registry import Catalogue

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


@C.add("order_nulls", "SELECT nullif(n_regionkey, 2) AS k, n_nationkey FROM nation ORDER BY k ASC NULLS FIRST, n_nationkey LIMIT 7")
def _(t):
    return rel.limit_offset(t.nation.select(F.nullif("n_regionkey", F.lit(2)).alias("k"), "n_nationkey"), [F.asc("k"), F.asc("n_nationkey")], 7)


@C.add("order_nulls_desc", "SELECT nullif(n_regionkey, 2) AS k, n_nationkey FROM nation ORDER BY k DESC NULLS LAST, n_nationkey LIMIT 22")
def _(t):
    return rel.limit_offset(t.nation.select(F.nullif("n_regionkey", F.lit(2)).alias("k"), "n_nationkey"), [F.desc("k"), F.asc("n_nationkey")], 22)


C.sql("order_ordinal", "customer", "SELECT c_name, c_acctbal FROM customer ORDER BY 2 DESC, 1 LIMIT 9")
C.sql("order_by_aggregate", "orders", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 5")
C.sql("order_expr", "part", "SELECT p_partkey FROM part ORDER BY p_size * p_retailprice, p_partkey LIMIT 11")


@C.add("order_by_json_member", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events ORDER BY k DESC NULLS LAST, event_id LIMIT 12")
def _(t):
    k = F.get_json_object("props", "$.k").cast("double")
    return rel.limit_offset(t.events.select("event_id", k.alias("k")), [F.desc("k"), F.asc("event_id")], 12)


@C.add("order_rand", "SELECT n_nationkey FROM nation")
def _(t):
    return t.nation.select("n_nationkey").orderBy(F.rand(3))


@C.add("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return rel.limit_offset(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@C.add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
def _(t):
    return rel.limit_offset(t.orders.select("o_orderkey"), [F.asc("o_orderkey")], 10, 25)


C.sql("limit_zero", "orders", "SELECT o_orderkey, o_orderstatus FROM orders LIMIT 0")


@C.add("found_rows", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 3")
def _(t):
    rows, total = rel.found_rows(t.orders, [F.asc("o_orderkey")], 3)
    return rows.select("o_orderkey", F.lit(total).cast("long").alias("total"))


C.sql("union_distinct", "nation supplier", "SELECT nullif(n_nationkey, 3) AS k FROM nation UNION SELECT nullif(s_nationkey, 3) FROM supplier")
C.sql("union_all", "nation supplier", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
C.sql("union_order_limit", "nation supplier", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier ORDER BY k DESC LIMIT 6")


@C.add("union_decimal_widen", "SELECT CAST(n_nationkey AS DECIMAL(20,10)) AS d FROM nation UNION ALL SELECT CAST(r_regionkey AS DECIMAL(20,10)) FROM region")
def _(t):
    return rel.union_types(t.nation.select(F.col("n_nationkey").cast("decimal(10,0)").alias("d")), t.region.select(F.col("r_regionkey").cast("decimal(18,10)").alias("d")))


@C.add("union_mixed_type", "SELECT CAST(n_nationkey AS VARCHAR) AS v FROM nation UNION ALL SELECT r_name FROM region")
def _(t):
    return rel.union_types(t.nation.select(F.col("n_nationkey").alias("v")), t.region.select("r_name"))


C.sql("union_in_derived", "nation region", "SELECT k, count(*) AS n FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) u GROUP BY k")
C.sql("intersect", "nation supplier", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
C.sql("except", "orders lineitem", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")


@C.add("row_number_total_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no FROM orders")
def _(t):
    return numbering.number_rows(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "row_no")


@C.add("dense_rank_group_id", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) AS group_id FROM orders")
def _(t):
    return numbering.dense_ranks(t.orders.select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", F.col("group_id").cast("long"))


@C.add("lag_prev_value", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events")
def _(t):
    return along(t.events.select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], previous=("value", "prev")).select("event_id", "prev")


@C.add("rank_reset", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank_no FROM orders")
def _(t):
    return along(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], number="rank_no").select("o_orderkey", "rank_no")


@C.add("running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return along(o, "o_custkey", ["o_orderdate", "o_orderkey"], total=("o_totalprice", "s")).select("o_orderkey", F.round("s", 2).alias("total"))


@C.add(
    "along_hot_group",
    """SELECT event_id, row_number() OVER w AS no, CAST(sum(user_id) OVER w AS BIGINT) AS total, lag(value) OVER w AS prev FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS u FROM events)
    WINDOW w AS (PARTITION BY u ORDER BY ts, event_id)""",
)
def _(t):
    # a third of all rows in one group; the plan for large groups is forced
    e = t.events.select("event_id", "user_id", "ts", "value", F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")).cast("long").alias("u"))
    return along(e, "u", ["ts", "event_id"], number="no", total=("user_id", "total"), previous=("value", "prev"), group_rows=0).select("event_id", "no", "total", "prev")
