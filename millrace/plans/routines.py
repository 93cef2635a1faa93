"""Stored routines, cursors, table functions and files as values."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.cursors import Cursor
from millrace.plans.registry import Catalogue

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


@C.add("routine_loop", "SELECT 55::BIGINT AS total, 10 AS steps")
def _(t):
    # DECLARE, WHILE and SET of a stored procedure, as a SQL script
    return t.spark.sql("""BEGIN
      DECLARE i INT = 0; DECLARE total BIGINT = 0;
      WHILE i < 10 DO SET i = i + 1; SET total = total + i; END WHILE;
      SELECT total AS total, i AS steps;
    END""")


@C.add("routine_branch", "SELECT CASE WHEN count(*) > 20 THEN 'many' ELSE 'few' END AS v FROM nation")
def _(t):
    t.nation.createOrReplaceTempView("nation")
    return t.spark.sql("""BEGIN
      DECLARE n BIGINT;
      SET n = (SELECT count(*) FROM nation);
      IF n > 20 THEN SELECT 'many' AS v; ELSE SELECT 'few' AS v; END IF;
    END""")


@C.add("cursor_rows", "SELECT page, n_nationkey, n_name FROM (SELECT CAST((row_number() OVER (ORDER BY n_name DESC, n_nationkey) - 1) // 10 AS INTEGER) AS page, n_nationkey, n_name FROM nation)")
def _(t):
    # OPEN, FETCH and CLOSE: pages of ten rows
    c = Cursor(t.nation.select("n_nationkey", "n_name"), [F.desc("n_name"), F.asc("n_nationkey")])
    pages = [c.fetch(10).withColumn("page", F.lit(n)) for n in range(3)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@C.add("table_function", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1)::INTEGER AS place FROM part")
def _(t):
    # a table function of the JVM: one row for each word of a name
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word")).withColumn("place", F.col("place") + 1)


@C.add("table_function_user", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def _(t):
    # a table function of the user, called for each row of a table

    @F.udtf(returnType="word string")
    class Words:
        def eval(self, name: str):
            for w in name.split(" ") if name is not None else ():
                yield (w,)

    t.spark.udtf.register("millrace_words", Words)
    t.part.createOrReplaceTempView("part")
    return t.spark.sql("SELECT p_partkey, word FROM part, LATERAL millrace_words(p_name)")


@C.add("load_file", "SELECT 'region.parquet' AS name, '50415231' AS magic, true AS whole")
def _(t):
    # the content of a file as a value; a directory table gives one row for each file
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{t.dir}/region.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.hex(F.substring("content", 1, 4)).alias("magic"), (F.octet_length("content") == F.col("length")).alias("whole"))


@C.add("statement_sequence", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 20 GROUP BY n_regionkey")
def _(t):
    # a session variable set by one statement and read by the next
    t.nation.createOrReplaceTempView("nation")
    t.spark.sql("DECLARE OR REPLACE VARIABLE millrace_top INT")
    t.spark.sql("SET VAR millrace_top = (SELECT 20)")
    return t.spark.sql("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < millrace_top GROUP BY n_regionkey")
