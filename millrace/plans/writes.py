"""INSERT, UPDATE, DELETE and their relatives, as transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import dml
from millrace.operators import relational as rel
from millrace.plans.registry import Catalogue

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


def _batch(t):
    """A batch with known and new keys, in which keys repeat; seq orders it."""
    o = t.orders.where("o_orderkey % 10 = 0")
    known = o.select("o_orderkey", "o_custkey", F.lit(1.0).alias("o_totalprice"), F.lit(1).alias("seq"))
    again = o.where("o_orderkey % 20 = 0").select("o_orderkey", "o_custkey", F.lit(2.0).alias("o_totalprice"), F.lit(2).alias("seq"))
    new = o.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_custkey", F.lit(3.0).alias("o_totalprice"), F.lit(3).alias("seq"))
    return known.unionByName(again).unionByName(new)


_BATCH = """b AS (
  SELECT o_orderkey, o_custkey, 1.0::DOUBLE AS o_totalprice, 1 AS seq FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT o_orderkey, o_custkey, 2.0, 2 FROM orders WHERE o_orderkey % 20 = 0
  UNION ALL SELECT -o_orderkey - 1, o_custkey, 3.0, 3 FROM orders WHERE o_orderkey % 10 = 0),
l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1)"""
_COLS = "o_orderkey, o_custkey, o_totalprice"


@C.add("insert_select", f"SELECT {_COLS} FROM orders UNION ALL SELECT {_COLS} FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    o = _orders(t)
    return dml.insert(o, t.orders.where("o_orderstatus = 'P'").select(*o.columns))


@C.add("insert_ignore", f"WITH {_BATCH} SELECT {_COLS} FROM orders UNION ALL SELECT {_COLS} FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(t):
    return dml.insert_ignore(_orders(t), _batch(t), ["o_orderkey"], "seq")


@C.add("replace_into", f"WITH {_BATCH} SELECT {_COLS} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l) UNION ALL SELECT {_COLS} FROM l")
def _(t):
    return dml.replace_into(_orders(t), _batch(t), ["o_orderkey"], "seq")


@C.add(
    "upsert_on_duplicate",
    f"""WITH {_BATCH} SELECT o.o_orderkey, o.o_custkey, CASE WHEN l.o_orderkey IS NULL THEN o.o_totalprice ELSE l.o_totalprice + 1 END AS o_totalprice
    FROM orders o LEFT JOIN l USING (o_orderkey) UNION ALL SELECT {_COLS} FROM l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
)
def _(t):
    return dml.upsert(_orders(t), _batch(t), ["o_orderkey"], "seq", {"o_totalprice": F.col("new.o_totalprice") + 1})


@C.add("update_sequential", "SELECT o_orderkey, o_custkey + 100 AS o_custkey, o_totalprice + o_custkey + 100 AS o_totalprice FROM orders")
def _(t):
    return dml.update(_orders(t), {"o_custkey": F.col("o_custkey") + 100, "o_totalprice": F.col("o_totalprice") + F.col("o_custkey")})


@C.add("update_where", "SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _(t):
    return dml.update(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 0)


@C.add("update_ignore", "SELECT CASE WHEN n_nationkey = 24 THEN 25 ELSE n_nationkey END::INTEGER AS n_nationkey, n_name FROM nation")
def _(t):
    return dml.update_ignore(t.nation.select("n_nationkey", "n_name"), "n_nationkey", F.col("n_nationkey") + 1)


@C.add("update_order_limit", "SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 5) THEN -1 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _(t):
    return dml.update_limit(t.supplier.select("s_suppkey", "s_acctbal"), {"s_acctbal": F.lit(-1.0)}, F.lit(True), [F.col("s_acctbal"), F.col("s_suppkey")], 5, ["s_suppkey"])


@C.add(
    "update_join",
    "SELECT s.s_suppkey, s.s_nationkey, CASE WHEN n.n_regionkey = 1 THEN n.n_name ELSE s.s_name END AS s_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey",
)
def _(t):
    n = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return dml.update_join(t.supplier.select("s_suppkey", "s_nationkey", "s_name"), n, ["s_nationkey"], {"s_name": F.col("o.n_name")})


@C.add("delete_where", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_custkey, 5) > 700, false)")
def _(t):
    o = t.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(5)).alias("k"))
    return dml.delete(o, F.col("k") > 700).select("o_orderkey")


@C.add("delete_order_limit", f"SELECT {_COLS} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")
def _(t):
    return dml.delete_limit(_orders(t), F.col("o_totalprice") > 1000, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10, ["o_orderkey"])


@C.add("delete_join", f"SELECT {_COLS} FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t):
    return dml.delete_join(_orders(t), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@C.add("delete_without_partner", f"SELECT {_COLS} FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    return dml.delete_join(_orders(t), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"], matching=False)


@C.add("truncate_table", "SELECT r_regionkey, r_name FROM region LIMIT 0")
def _(t):
    return dml.truncate(t.region.select("r_regionkey", "r_name"))


@C.add("auto_increment", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 24 + row_number() OVER (ORDER BY r_regionkey), r_name FROM region")
def _(t):
    have = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return dml.auto_increment(have, t.region.select("r_regionkey", F.col("r_name").alias("name")), "id", [F.col("r_regionkey")])


@C.add("primary_key_guard", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1)")
def _(t):
    key = ["l_orderkey", "l_linenumber"]
    once = t.lineitem.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*key)
    return dml.require_unique(once, key)


@C.add("check_option", "SELECT n_nationkey, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation WHERE n_regionkey < 3")
def _(t):
    n = t.nation.select("n_nationkey", "n_regionkey")
    return dml.insert_through_view(n, n.where("n_regionkey < 3").select(F.col("n_nationkey") + 100, "n_regionkey"), F.col("n_regionkey") < 3)


@C.add("alter_add_column", "SELECT r_regionkey, r_name, 0 AS flag FROM region")
def _(t):
    return dml.add_column(t.region.select("r_regionkey", "r_name"), "flag", F.lit(0))


@C.add("alter_change_column", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name FROM region")
def _(t):
    return dml.change_column(t.region.select("r_regionkey", "r_name"), "r_regionkey", "id", "bigint")


@C.add("clamp_out_of_range", "SELECT l_orderkey, l_linenumber, CAST(least(greatest(l_quantity * 5, -128), 127) AS TINYINT) AS q FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.least(F.greatest(F.col("l_quantity") * 5, F.lit(-128.0)), F.lit(127.0)).cast("tinyint").alias("q"))


# --- batches that repeat keys ---


@C.add(
    "upsert_folded",
    """WITH b AS (SELECT CASE WHEN l_returnflag = 'R' THEN -l_orderkey ELSE l_orderkey END AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
    SELECT o_orderkey, round(o_totalprice + coalesce(q, 0), 2) AS o_totalprice FROM orders LEFT JOIN b ON k = o_orderkey UNION ALL SELECT k, round(q, 2) FROM b WHERE k NOT IN (SELECT o_orderkey FROM orders)""",
)
def _(t):
    # every line adds its quantity to its order; the lines of returned ones begin new keys
    key = F.when(F.col("l_returnflag") == "R", -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("o_orderkey")
    lines = t.lineitem.select(key, F.col("l_quantity").alias("o_totalprice"), F.col("l_linenumber").alias("seq"))
    out = dml.upsert(t.orders.select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"], "seq", {"o_totalprice": dml.Plus(F.col("new.o_totalprice"))})
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@C.add(
    "upsert_in_order",
    """SELECT o_orderkey, round(list_reduce(list_prepend(o_totalprice, q), lambda a, x: a * 0.5 + x), 4) AS v FROM
    (SELECT o_orderkey, any_value(o_totalprice) AS o_totalprice, coalesce(list(l_quantity ORDER BY l_linenumber, l_quantity) FILTER (WHERE l_quantity IS NOT NULL), []) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)""",
)
def _(t):
    # an assignment whose result depends on the order of the rows
    lines = t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("v"), F.col("l_linenumber").alias("seq"))
    out = dml.upsert(t.orders.select("o_orderkey", F.col("o_totalprice").alias("v")), lines, ["o_orderkey"], "seq", {"v": lambda old, new: old["v"] * 0.5 + new["v"]})
    return out.withColumn("v", F.round("v", 4))


@C.add(
    "update_join_repeats",
    """SELECT s_suppkey, coalesce(c_name, s_name) AS s_name FROM supplier LEFT JOIN (SELECT c_nationkey, first(c_name ORDER BY c_acctbal DESC, c_custkey) AS c_name FROM customer GROUP BY 1) ON c_nationkey = s_nationkey""",
)
def _(t):
    # a supplier has many customers in its nation; the one with the largest balance counts
    c = t.customer.select(F.col("c_nationkey").alias("s_nationkey"), "c_name", "c_acctbal", "c_custkey")
    return dml.update_join(t.supplier.select("s_suppkey", "s_nationkey", "s_name"), c, ["s_nationkey"], {"s_name": F.col("o.c_name")}, [-F.col("c_acctbal"), F.col("c_custkey")]).select("s_suppkey", "s_name")


@C.add("delete_not_in_correlated", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < o_totalprice / 60), false)")
def _(t):
    o = _orders(t)
    gone = rel.not_in_range(o.withColumn("b", F.col("o_totalprice") / 60), "o_custkey", "b", t.customer, "c_custkey", "c_acctbal", "<")
    return dml.delete_join(o, gone, ["o_orderkey"]).select("o_orderkey")


# --- statements that are refused ---


def _refused(t, error, act):
    try:
        act()
        refused = False
    except error:
        refused = True
    return t.spark.range(1).select(F.lit(refused).alias("refused"))


@C.add("check_option_refused", "SELECT count(*) > 0 AS refused FROM nation WHERE n_regionkey >= 3")
def _(t):
    n = t.nation.select("n_nationkey", "n_regionkey")
    return _refused(t, dml.CheckFailed, lambda: dml.insert_through_view(n, n, F.col("n_regionkey") < 3))


@C.add("primary_key_refused", "SELECT count(*) > 0 AS refused FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey HAVING count(*) > 1)")
def _(t):
    return _refused(t, dml.DuplicateKey, lambda: dml.require_unique(t.lineitem, ["l_orderkey"]))


@C.add("union_column_count_refused", "SELECT true AS refused")
def _(t):
    return _refused(t, ValueError, lambda: rel.union_types(t.nation.select("n_nationkey"), t.region.select("r_regionkey", "r_name")))


@C.add("alter_drop_column", "SELECT r_regionkey FROM region")
def _(t):
    return dml.drop_column(t.region.select("r_regionkey", "r_name"), "r_name")


@C.add("alter_modify_column", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(14,1)) AS o_totalprice FROM orders")
def _(t):
    return dml.modify_column(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "decimal(14,1)")
