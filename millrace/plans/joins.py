"""Joins, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import relational as rel
from millrace.plans.registry import Catalogue

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


@C.add("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


C.sql("join_comma", "orders lineitem", "SELECT o_orderkey, sum(l_quantity) AS q FROM orders, lineitem WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P' GROUP BY o_orderkey")


@C.add("join_hash_hint", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def _(t):
    return t.lineitem.join(t.supplier.hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "s_name")


@C.add("join_left_on_filter", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000")
def _(t):
    return t.nation.join(t.supplier, (F.col("n_nationkey") == F.col("s_nationkey")) & (F.col("s_acctbal") > 5000), "left").select("n_nationkey", "s_suppkey")


@C.add("join_right", "SELECT s_suppkey, n_nationkey FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey")
def _(t):
    return t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "right").select("s_suppkey", "n_nationkey")


@C.add("join_right_is_null", "SELECT o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def _(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "right").where(F.col("l_orderkey").isNull()).select("o_orderkey")


@C.add("join_full_outer", "SELECT n_nationkey, s_suppkey FROM (SELECT * FROM nation WHERE n_regionkey < 3) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON n_nationkey = s_nationkey")
def _(t):
    return t.nation.where("n_regionkey < 3").join(t.supplier.where("s_acctbal > 0"), F.col("n_nationkey") == F.col("s_nationkey"), "full").select("n_nationkey", "s_suppkey")


@C.add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(t):
    # a cartesian product is only built of sides whose size was checked: five and twenty-five rows
    return t.nation.crossJoin(rel.small(t.region, 100)).select("r_name", "n_name")


@C.add("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def _(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") > F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@C.add("join_not_equal", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey <> r_regionkey")
def _(t):
    return t.nation.join(rel.small(t.region, 100), F.col("n_regionkey") != F.col("r_regionkey")).select("n_nationkey", "r_regionkey")


@C.add("join_or", "SELECT o_orderkey, n_nationkey FROM orders JOIN nation ON o_orderkey = n_nationkey OR o_custkey = n_nationkey")
def _(t):
    # an OR of two equalities is a union of two equi joins, the second without the rows of the first
    o, n = t.orders.select("o_orderkey", "o_custkey"), t.nation.select("n_nationkey")
    one = o.join(n, F.col("o_orderkey") == F.col("n_nationkey"))
    two = o.join(n, F.col("o_custkey") == F.col("n_nationkey")).where(~F.col("o_orderkey").eqNullSafe(F.col("n_nationkey")))
    return one.union(two).select("o_orderkey", "n_nationkey")


@C.add("join_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) LEFT JOIN (SELECT r_regionkey AS k, r_name FROM region WHERE r_regionkey < 3) USING (k)")
def _(t):
    return t.nation.select(F.col("n_regionkey").alias("k"), "n_name").join(t.region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("k"), "r_name"), ["k"], "left")


@C.add("join_natural", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
def _(t):
    return rel.natural_join(t.nation.select(F.col("n_regionkey").alias("k"), "n_name"), t.region.select(F.col("r_regionkey").alias("k"), "r_name")).select("k", "n_name", "r_name")


@C.add("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def _(t):
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


_MULTI = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
 LEFT JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""
C.sql("join_multiway", "lineitem orders customer nation region supplier part", f"SELECT r_name, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS q {_MULTI} GROUP BY r_name, p_brand")


@C.add(
    "join_thirteen",
    """SELECT count(*) AS n, count(t1.n_nationkey) AS a, sum(t16.r_regionkey) AS b FROM nation t1 RIGHT JOIN supplier t2 ON t1.n_nationkey = t2.s_nationkey JOIN region t3 ON t1.n_regionkey = t3.r_regionkey
    RIGHT JOIN nation t4 ON t1.n_nationkey = t4.n_nationkey LEFT JOIN nation t5 ON t1.n_nationkey = t5.n_nationkey JOIN region t6 ON t4.n_regionkey = t6.r_regionkey LEFT JOIN part t7 ON t2.s_suppkey = t7.p_partkey
    RIGHT JOIN customer t8 ON t4.n_nationkey = t8.c_nationkey RIGHT JOIN nation t10 ON t8.c_nationkey = t10.n_nationkey RIGHT JOIN nation t11 ON t10.n_nationkey = t11.n_nationkey RIGHT JOIN nation t13 ON t11.n_nationkey = t13.n_nationkey
    RIGHT JOIN region t15 ON t13.n_regionkey = t15.r_regionkey RIGHT JOIN region t16 ON t15.r_regionkey = t16.r_regionkey""",
)
def _(t):
    # each nation's rows are the product of its suppliers and customers: no join makes them, tables are counted by the columns
    # that are still needed and the counts multiplied. Parts meet suppliers first, for nothing after them reads a part
    def nation(i, *region):
        return rel.counted(t.nation.select(F.col("n_nationkey").alias(f"n{i}"), *(F.col("n_regionkey").alias(r) for r in region)), f"n{i}", *region)

    def region(i):
        return rel.counted(t.region.select(F.col("r_regionkey").alias(f"r{i}")), f"r{i}")

    eq = lambda a, b: F.col(a) == F.col(b)
    part = rel.counted(t.part.select(F.col("p_partkey").alias("p7")), "p7")
    supplier = rel.counted(rel.counted_join(t.supplier.select(F.col("s_suppkey").alias("s2"), F.col("s_nationkey").alias("n2")), part, eq("s2", "p7"), "left"), "n2")
    customer = rel.counted(t.customer.select(F.col("c_nationkey").alias("n8")), "n8")
    j = rel.counted_join(nation(1, "r1"), supplier, eq("n1", "n2"), "right")
    j = rel.counted(rel.counted_join(j, region(3), eq("r1", "r3")), "n1")
    j = rel.counted_join(j, nation(4, "r4"), eq("n1", "n4"), "right")
    j = rel.counted_join(j, nation(5), eq("n1", "n5"), "left")
    j = rel.counted(rel.counted_join(j, region(6), eq("r4", "r6")), "n1", "n4")
    j = rel.counted_join(j, customer, eq("n4", "n8"), "right")
    j = rel.counted_join(j, nation(10), eq("n8", "n10"), "right")
    j = rel.counted_join(j, nation(11), eq("n10", "n11"), "right")
    j = rel.counted_join(j, nation(13, "r13"), eq("n11", "n13"), "right")
    j = rel.counted_join(j, region(15), eq("r13", "r15"), "right")
    j = rel.counted_join(j, region(16), eq("r15", "r16"), "right")
    times, none = F.col(rel.TIMES), F.lit(0)
    return j.agg(F.coalesce(F.sum(times), none).alias("n"), F.coalesce(F.sum(F.when(F.col("n1").isNotNull(), times)), none).alias("a"), F.sum(F.col("r16") * times).alias("b"))


@C.add("join_straight_order", "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    j = rel.straight_join(t.orders, (t.customer, F.col("o_custkey") == F.col("c_custkey")), (t.nation, F.col("c_nationkey") == F.col("n_nationkey")))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@C.add("join_hash_side", "SELECT l_orderkey, l_linenumber, s_name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey")
def _(t):
    # whichever side is written first, the table is built from the smaller one
    s = t.supplier.select(F.col("s_suppkey").alias("k"), "s_name")
    return rel.hash_join(s, t.lineitem.select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber"), ["k"]).select("l_orderkey", "l_linenumber", "s_name")


@C.add("join_skewed_full", "SELECT user_id, c_name, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id FROM events) FULL JOIN (SELECT c_custkey AS user_id, c_name FROM customer) USING (user_id) GROUP BY ALL")
def _(t):
    e = t.events.select(F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")).cast("long").alias("user_id"))
    return rel.spread_join(e, t.customer.select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "full").groupBy("user_id", "c_name").agg(F.count(F.lit(1)).alias("n"))


C.sql("join_nested", "region nation supplier", "SELECT r_regionkey, n_nationkey, s_suppkey FROM region LEFT JOIN (nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 8000) ON r_regionkey = n_regionkey AND n_nationkey > 10")


@C.add("join_mixed_sign_keys", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    # unsigned keys are DECIMAL(20,0) or BIGINT; both sides are cast to BIGINT before they meet
    c = t.customer.select(F.col("c_custkey").cast("decimal(20,0)").alias("k"))
    return t.orders.join(c, F.col("o_custkey") == F.col("k").cast("long")).agg(F.count(F.lit(1)).alias("n"))


@C.add("join_skewed", "SELECT user_id, n_type, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id FROM events) JOIN (SELECT user_id, min(event_type) AS n_type FROM events GROUP BY user_id) USING (user_id) GROUP BY ALL")
def _(t):
    # a third of all rows hold one key; its rows are salted
    e = t.events.select(F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")).cast("long").alias("user_id"))
    u = t.events.groupBy("user_id").agg(F.min("event_type").alias("n_type"))
    return rel.spread_join(e, u, "user_id").groupBy("user_id", "n_type").agg(F.count(F.lit(1)).alias("n"))


@C.add("semi_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


C.sql("semi_exists", "orders lineitem", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
C.sql("exists_limit_zero", "region", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM region LIMIT 0)")
C.sql("anti_not_exists", "orders lineitem", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")


@C.add("anti_not_in", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return rel.not_in(t.orders, "o_orderkey", t.lineitem, "l_orderkey").select("o_orderkey")


@C.add("anti_not_in_null", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT nullif(l_orderkey, 3) FROM lineitem)")
def _(t):
    return rel.not_in(t.orders, "o_orderkey", t.lineitem.select(F.nullif("l_orderkey", F.lit(3)).alias("k")), "k").select("o_orderkey")


@C.add("anti_not_in_empty", "SELECT o_orderkey FROM orders WHERE nullif(o_orderkey, 5) NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 0)")
def _(t):
    o = t.orders.withColumn("k", F.nullif("o_orderkey", F.lit(5)))
    return rel.not_in(o, "k", t.lineitem.where("l_quantity < 0"), "l_orderkey").select("o_orderkey")


@C.add("correlated_range_not_in", "SELECT a.n_nationkey FROM nation a WHERE a.n_nationkey NOT IN (SELECT b.n_nationkey * 2 FROM nation b WHERE b.n_nationkey * 2 > a.n_regionkey)")
def _(t):
    b = t.nation.select((F.col("n_nationkey") * 2).alias("v"))
    return rel.not_in_range(t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey", b, "v", "v", ">").select("n_nationkey")


def _range_not_in(name, op):
    # null keys on both sides, an empty list where no customer is within the bound
    sql = f"SELECT o_orderkey FROM orders WHERE nullif(o_custkey, 5) NOT IN (SELECT CASE WHEN c_custkey % 3 = 0 AND c_acctbal NOT BETWEEN 4980 AND 5020 THEN c_custkey WHEN c_acctbal BETWEEN 4980 AND 5020 THEN NULL WHEN c_acctbal BETWEEN 0 AND 9000 THEN 1 ELSE 2 END FROM customer WHERE c_acctbal {op} o_totalprice / 50 - 1000)"

    @C.add(name, sql)
    def _(t):
        k, b = F.col("c_custkey"), F.col("c_acctbal")
        key = F.when((k % 3 == 0) & ~b.between(4980, 5020), k).when(b.between(4980, 5020), None).when(b.between(0, 9000), F.lit(1)).otherwise(F.lit(2))
        o = t.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(5)).alias("k"), (F.col("o_totalprice") / 50 - 1000).alias("b"))
        return rel.not_in_range(o, "k", "b", t.customer.select(key.cast("long").alias("ck"), b.alias("cb")), "ck", "cb", op).select("o_orderkey")


for _name, _op in (("less", "<"), ("less_equal", "<="), ("greater", ">"), ("greater_equal", ">=")):
    _range_not_in(f"correlated_not_in_{_name}", _op)


@C.add("eq_any", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = ANY (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)")
def _(t):
    return t.lineitem.join(t.supplier.where("s_acctbal > 9000"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_orderkey", "l_linenumber")


C.sql("nested_in", "customer nation region", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))")
C.sql("in_grouped_subquery", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT count(*) FROM orders GROUP BY o_custkey)")
C.sql("join_counts", "orders customer", """SELECT (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS i, (SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey) AS l,
    (SELECT count(*) FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) AS e, (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) AS n""")
