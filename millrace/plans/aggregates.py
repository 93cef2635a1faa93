"""Aggregation, grouping, distinct and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.aggregate import group_concat
from millrace.operators.relational import group_concat_limited
from millrace.plans.registry import Catalogue

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


@C.add(
    "agg_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def _(t):
    return (
        t.lineitem.where(F.col("l_shipdate") <= F.lit("1999-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
        )
    )


@C.add("agg_basic", "SELECT event_type, count(*) AS n, count(nullif(user_id, 1)) AS c, round(sum(value), 4) AS s, round(avg(value), 4) AS a, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def _(t):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif("user_id", F.lit(1))).alias("c"), F.round(F.sum(v), 4).alias("s"), F.round(F.avg(v), 4).alias("a"), F.min(v).alias("lo"), F.max(v).alias("hi"))


@C.add("agg_min_max_text_date", "SELECT o_orderstatus, min(o_orderpriority) AS p, max(o_orderdate) AS d, max(CAST(o_totalprice > 1000 AS INTEGER)) AS b FROM orders GROUP BY o_orderstatus")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(F.min("o_orderpriority").alias("p"), F.max("o_orderdate").alias("d"), F.max((F.col("o_totalprice") > 1000).cast("int")).alias("b"))


C.sql("agg_distinct", "lineitem", "SELECT l_returnflag, sum(DISTINCT l_quantity) AS s, round(avg(DISTINCT l_quantity), 4) AS a, min(DISTINCT l_quantity) AS lo, max(DISTINCT l_quantity) AS hi FROM lineitem GROUP BY l_returnflag")
C.sql("count_distinct", "lineitem", "SELECT count(DISTINCT nullif(l_returnflag, 'N')) AS f, count(DISTINCT l_partkey) AS p FROM lineitem")


@C.add("count_distinct_pair", "SELECT count(DISTINCT (a, b)) AS n FROM (SELECT nullif(l_returnflag, 'N') AS a, nullif(l_linestatus, 'F') AS b FROM lineitem) WHERE a IS NOT NULL AND b IS NOT NULL")
def _(t):
    return t.lineitem.agg(F.count_distinct(F.nullif("l_returnflag", F.lit("N")), F.nullif("l_linestatus", F.lit("F"))).alias("n"))


@C.add("group_concat_ordered", "SELECT n_regionkey, string_agg(n_name, ':' ORDER BY n_name DESC) AS names, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(group_concat("n_name", ":", descending=True).alias("names"), group_concat("n_nationkey").alias("keys"))


@C.add("group_concat_distinct", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(group_concat("o_orderpriority", distinct=True).alias("p"))


C.sql("var_samp", "lineitem", "SELECT l_returnflag, round(var_samp(l_quantity), 4) AS v, round(stddev_samp(l_quantity), 4) AS s FROM lineitem GROUP BY l_returnflag")
C.sql("group_by_expr", "customer", "SELECT substr(c_name, 1, 10) AS p, count(*) AS n FROM customer GROUP BY substr(c_name, 1, 10)")
C.sql("group_by_alias", "orders", "SELECT o_custkey % 7 AS bucket, count(*) AS n FROM orders GROUP BY bucket")
C.sql("group_by_mod", "orders", "SELECT o_orderkey % 13 AS m, count(*) AS n, min(o_orderkey) AS lo FROM orders GROUP BY o_orderkey % 13")
C.sql("group_by_order", "orders", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority DESC")
C.sql("having_agg", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
C.sql("having_alias", "orders", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING total > 20000", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING round(sum(o_totalprice), 2) > 20000")
C.sql("having_subquery", "orders", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING avg(o_totalprice) > (SELECT avg(o_totalprice) FROM orders)")
C.sql("agg_over_join", "orders lineitem", "SELECT o_orderpriority, round(sum(l_quantity * l_tax), 4) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
C.sql("agg_over_agg", "orders", "SELECT avg(n) AS a, max(n) AS m FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) g")
C.sql("agg_of_function", "part", "SELECT p_brand, sum(length(p_name) / 2) AS s FROM part GROUP BY p_brand")
C.sql("agg_empty_input", "orders", "SELECT sum(o_totalprice) AS s, count(*) AS n, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
C.sql("agg_bool_expr", "orders", "SELECT o_orderstatus, sum(CAST((o_totalprice > 1000) AS INT)) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(CAST((o_totalprice > 1000) AS INT)) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
C.sql("group_null_key", "lineitem", "SELECT nullif(l_returnflag, 'N') AS f, count(*) AS n FROM lineitem GROUP BY nullif(l_returnflag, 'N')")


@C.add("pivot_case", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def _(t):
    # values are named, so that no extra job collects them
    out = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("o_orderpriority", *[F.coalesce(F.col(s), F.lit(0)).alias(s.lower()) for s in "FOP"])


C.sql("select_distinct", "lineitem", "SELECT DISTINCT nullif(l_returnflag, 'N') AS f, l_linestatus FROM lineitem")
C.sql("select_distinct_limit", "lineitem", "SELECT DISTINCT nullif(l_returnflag, 'N') AS f FROM lineitem ORDER BY f DESC LIMIT 2", "SELECT DISTINCT nullif(l_returnflag, 'N') AS f FROM lineitem ORDER BY f DESC NULLS LAST LIMIT 2")
C.sql("rollup", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
C.sql("cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
C.sql("grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@C.add("group_concat_max_len", "SELECT l_returnflag, left(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey), 1024) AS v FROM lineitem GROUP BY l_returnflag")
def _(t):
    # a result of 1024 signs needs no more than the first 1024 values of a group
    return group_concat_limited(t.lineitem.select("l_returnflag", "l_partkey"), ["l_returnflag"], "l_partkey", "v")
