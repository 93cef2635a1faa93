"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.registry import Catalogue
from millrace.session import cut
from millrace.sources import delimited
from millrace.sources.files import remove, shared_dir

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


@C.add("scan_parquet", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'")
def _(t):
    return t.lineitem.where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", "l_quantity")


@C.add("scan_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def _(t):
    return t.orders.where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@C.add("scan_union_paths", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(t):
    return t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).unionByName(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))


C.sql("dual_literals", "", "SELECT 10 + 2 AS a, 2222 AS b, 'x' AS c")
C.sql("derived_table", "orders", "SELECT s, count(*) AS n FROM (SELECT o_orderstatus AS s, o_custkey FROM orders WHERE o_totalprice > 1000) t GROUP BY s")


@C.add("view_read", "SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY o_orderstatus")
def _(t):
    t.orders.where("o_orderpriority = '1-URGENT'").createOrReplaceTempView("urgent_orders")
    return t.spark.sql("SELECT o_orderstatus, count(*) AS n FROM urgent_orders GROUP BY o_orderstatus")


@C.add("temporary_table_shadow", "SELECT 1 AS step, n_nationkey, n_name FROM nation UNION ALL SELECT 2, 1, 'shadow' UNION ALL SELECT 3, n_nationkey, n_name FROM nation")
def _(t):
    # a temporary view hides the table of the same name until it is dropped
    spark, name = t.spark, "millrace_nation"
    spark.catalog.dropTempView(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, f"{t.dir}/nation.parquet", "parquet")
    read = lambda n: spark.table(name).select(F.lit(n).alias("step"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    steps = [read(1)]
    spark.sql("SELECT 1 AS n_nationkey, 'shadow' AS n_name").createOrReplaceTempView(name)
    steps.append(read(2))
    spark.catalog.dropTempView(name)
    steps.append(read(3))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


@C.add("csv_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    # LOAD DATA of what INTO OUTFILE wrote; the rows are checkpointed, so the files can go
    path = shared_dir(t.spark)
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    delimited.export(n, path, sep="|", quote='"')
    out = cut(delimited.load(t.spark, path, n.schema, sep="|", quote='"'))
    remove(t.spark, path)
    return out


@C.add("csv_roundtrip_orders", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def _(t):
    path = shared_dir(t.spark)
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    delimited.export(o, path, sep="\t")
    out = cut(delimited.load(t.spark, path, o.schema, sep="\t"))
    remove(t.spark, path)
    return out


@C.add("load_columns_defaults", "SELECT n_nationkey AS k, 'none' AS note, upper(n_name) AS name FROM nation")
def _(t):
    # a list of the file's columns, a default for the rest, and SET with a computed value
    path = shared_dir(t.spark)
    delimited.export(t.nation.select("n_nationkey", "n_name"), path, sep=",")
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("name", T.StringType())])
    out = cut(delimited.load(t.spark, path, schema, sep=",", columns=["k", "v1"], defaults={"note": F.lit("none")}, set_={"name": F.upper("v1")}))
    remove(t.spark, path)
    return out


@C.add("reject_guard", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 0")
def _(t):
    # every fifth key is written as text that is no number; the load rejects those rows and keeps the rest
    path = shared_dir(t.spark)
    bad = F.when(F.col("n_nationkey") % 5 == 0, F.lit("x")).otherwise(F.col("n_nationkey").cast("string"))
    delimited.export(t.nation.select(bad.alias("k"), "n_name"), path, sep=";")
    out = cut(delimited.load(t.spark, path, t.nation.select("n_nationkey", "n_name").schema, sep=";", abort_share=0.5))
    remove(t.spark, path)
    return out


@C.add("ctas_like", "SELECT r_regionkey, r_name FROM region WHERE false")
def _(t):
    from millrace.operators.dml import create_like

    return create_like(t.region.select("r_regionkey", "r_name"))


@C.add("ctas", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def _(t):
    path = shared_dir(t.spark)
    t.nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    out = cut(t.spark.read.parquet(path))
    remove(t.spark, path)
    return out


@C.add("partitioned_write", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    path = shared_dir(t.spark)
    o = t.orders.select("o_orderkey", "o_orderstatus")
    o.repartition("o_orderstatus").write.mode("overwrite").partitionBy("o_orderstatus").parquet(path)
    out = cut(t.spark.read.schema(o.schema).parquet(path).where("o_orderstatus = 'P'"))  # prunes to one directory
    remove(t.spark, path)
    return out


@C.add("generated_column", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _(t):
    return t.lineitem.withColumn("net", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).select("l_orderkey", "l_linenumber", "net")


@C.add("document_find", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 ORDER BY 2, 1 LIMIT 20")
def _(t):
    from millrace.operators.collections import find, member

    k = member("props", "$.k", "int")
    return find(t.events, k > 50, [k.asc(), F.col("event_id").asc()], 20).select("event_id", k.alias("k"))


@C.add("document_modify", "SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def _(t):
    from millrace.operators.collections import member, modify

    out = modify(t.events.select("event_id", "props"), "props", "$.k", F.lit(0), member("props", "$.k", "int") > 50)
    return out.select("event_id", member("props", "$.k", "int").alias("k"))


@C.add("load_ignore_lines", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    # two lines at the start of the file are ignored
    path = shared_dir(t.spark)
    n = t.nation.select("n_nationkey", "n_name")
    head = t.spark.createDataFrame([(0, "key;name"), (1, "-")], "at int, value string")
    lines = head.unionByName(n.select(F.lit(2).alias("at"), F.concat_ws(";", F.coalesce(F.col("n_nationkey").cast("string"), F.lit("\\N")), F.coalesce("n_name", F.lit("\\N"))).alias("value")))
    lines.repartition(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
    out = cut(delimited.load(t.spark, path, n.schema, sep=";", skip=2))
    remove(t.spark, path)
    return out


@C.add("csv_roundtrip_odd_values", "SELECT p_partkey, 'a' || chr(10) || p_name || chr(13) || chr(9) || '|\"\\' || p_type AS v, nullif(p_brand, 'Brand#11') AS w FROM part")
def _(t):
    # line ends, tabs, separators, quotes and escape signs inside values come back, NULL stays apart from ''
    path = shared_dir(t.spark)
    v = F.concat(F.lit("a\n"), "p_name", F.lit('\r\t|"\\'), "p_type")
    p = t.part.select("p_partkey", v.alias("v"), F.nullif("p_brand", F.lit("Brand#11")).alias("w"))
    delimited.export(p, path, sep="|", quote='"')
    out = cut(delimited.load(t.spark, path, p.schema, sep="|", quote='"'))
    remove(t.spark, path)
    return out


@C.add("export_types", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,1)) AS VARCHAR) AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def _(t):
    # columns are cast on the way out; the file's texts come back
    path = shared_dir(t.spark)
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"))
    delimited.export(o, path, sep=",", types={"price": "decimal(12,1)", "day": "date"})
    schema = T.StructType([o.schema["o_orderkey"], T.StructField("price", T.StringType()), T.StructField("day", T.StringType())])
    out = cut(delimited.load(t.spark, path, schema, sep=","))
    remove(t.spark, path)
    return out


@C.add("document_modify_array", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS a, event_id AS b FROM events")
def _(t):
    # a position inside an array, below a member
    from millrace.operators.collections import member, modify

    e = t.events.select("event_id", F.concat(F.lit('{"list":['), F.get_json_object("props", "$.k"), F.lit(',{"b":0}]}')).alias("doc"))
    out = modify(e, "doc", "$.list[1].b", F.col("event_id"), F.lit(True))
    return out.select("event_id", member("doc", "$.list[0]", "int").alias("a"), member("doc", "$.list[1].b", "bigint").alias("b"))


@C.add("query_builder", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000 AND o_custkey IN (1, 2, 3, 4, 5, 6, 7, 8, 9) ORDER BY o_orderkey DESC LIMIT 7")
def _(t):
    from millrace.operators.collections import Query

    q = Query(t.orders).where("o_orderstatus", "eq", "status").where("o_totalprice", "between", "low", "high").where("o_custkey", "in", "keys").order("o_orderkey", descending=True).limit(7)
    return q.run(status="F", low=1000, high=200000, keys=list(range(1, 10))).select("o_orderkey", "o_totalprice")
