"""Joins of counted tables: the rows of the plain joins, without making them."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators import relational as rel


def most_rows(plan):
    """The largest number of rows that any operator of the executed plan gave."""
    if "AdaptiveSparkPlan" in plan.nodeName():
        return most_rows(plan.executedPlan())
    inner = [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, inner)])


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_counts_are_those_of_the_plain_join(spark, how):
    r = random.Random(how)
    some = lambda n: [(r.choice([None, 1, 2, 3, 4]), r.choice([None, "x", "y"])) for _ in range(n)]
    a = spark.createDataFrame([*some(20), (9, "a")], "k int, v string")
    b = spark.createDataFrame([*some(30), (8, "b")], "l int, w string")
    on, columns = F.col("k") == F.col("l"), ["k", "v", "l", "w"]
    plain = sorted((tuple(x) for x in a.join(b, on, how).groupBy(*columns).count().collect()), key=str)
    for x in (a, rel.counted(a, "k", "v")):
        for y in (b, rel.counted(b, "l", "w")):
            assert sorted((tuple(z) for z in rel.counted(rel.counted_join(x, y, on, how), *columns).collect()), key=str) == plain
    assert rel.counted(rel.counted(a, "k", "v"), "v").agg(F.sum(rel.TIMES)).first()[0] == 21


def test_counted_join_has_no_semi_join(spark):
    with pytest.raises(ValueError):
        rel.counted_join(spark.range(1), spark.range(1), F.lit(True), "left_semi")


def test_join_thirteen_with_repeats_and_nulls(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    sql, run = entry.oracle_sql()["join_thirteen"], entry.queries()["join_thirteen"]
    for seed in range(4):
        r, d = random.Random(seed), tmp_path / str(seed)
        key = lambda n, r=r: r.choice([None, *range(n)])
        made = {
            "region": ([(key(4), "r") for _ in range(5)], "r_regionkey int, r_name string"),
            "nation": ([(key(5), "n", key(4)) for _ in range(6)], "n_nationkey int, n_name string, n_regionkey int"),
            "supplier": ([(key(8), key(6)) for _ in range(9)], "s_suppkey long, s_nationkey int"),
            "customer": ([(i, key(6)) for i in range(9)], "c_custkey long, c_nationkey int"),
            "part": ([(key(8),) for _ in range(9)], "p_partkey long"),
        }
        for name, (rows, schema) in made.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
            con.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
        assert [tuple(x) for x in run(spark, str(d)).collect()] == con.sql(sql).fetchall()


def test_join_thirteen_makes_no_product(spark, tmp_path):
    # one nation has 300 suppliers and 2,000 customers, whose 600,000 rows must be counted, not made
    n, m, d = 300, 2000, str(tmp_path)
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{d}/region.parquet")
    spark.createDataFrame([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit(0).alias("s_nationkey")).write.parquet(f"{d}/supplier.parquet")
    spark.range(m).select(F.col("id").alias("c_custkey"), F.lit(0).alias("c_nationkey")).write.parquet(f"{d}/customer.parquet")
    spark.range(n, 2 * n).select(F.col("id").alias("p_partkey")).write.parquet(f"{d}/part.parquet")
    df = entry.queries()["join_thirteen"](spark, d)
    assert [tuple(x) for x in df.collect()] == [(n * m, n * m, 0)]
    assert m <= most_rows(df._jdf.queryExecution().executedPlan()) <= n + m
