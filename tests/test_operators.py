"""Writes, joins, numbering and delimited files, with nulls, ties, repeats and empty tables."""

import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import dml, numbering
from millrace.operators import relational as rel
from millrace.operators.collections import Query
from millrace.operators.cursors import Cursor
from millrace.operators.groups import along
from millrace.sources import delimited


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def base(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "id int, name string, v int")


@pytest.fixture
def batch(spark):
    return spark.createDataFrame([(2, "B", 5, 1), (2, "BB", 6, 2), (3, "c", 7, 3), (None, "N", 8, 4)], "id int, name string, v int, seq int")


def test_insert(base, spark):
    assert rows(dml.insert(base, spark.createDataFrame([("7", "x", "8")], "p string, q string, r string"))) == rows(base) [:0] + sorted([*map(tuple, base.collect()), (7, "x", 8)], key=str)
    with pytest.raises(ValueError):
        dml.insert(base, spark.createDataFrame([(1,)], "a int"))


def test_insert_ignore_replace_upsert(base, batch):
    assert rows(dml.insert_ignore(base, batch, ["id"], "seq")) == sorted([(1, "a", 10), (2, "b", 20), (3, "c", 7), (None, "n", 0)], key=str)
    assert rows(dml.replace_into(base, batch, ["id"], "seq")) == sorted([(1, "a", 10), (2, "BB", 6), (3, "c", 7), (None, "N", 8)], key=str)
    for add in (dml.Plus(F.col("new.v")), lambda old, new: old["v"] + new["v"]):
        got = dml.upsert(base, batch, ["id"], "seq", {"v": add})
        assert rows(got) == sorted([(1, "a", 10), (2, "b", 31), (3, "c", 7), (None, "n", 8)], key=str)
    for f in (dml.insert_ignore, dml.replace_into):
        assert rows(f(base, batch.limit(0), ["id"], "seq")) == rows(base)
        assert len(rows(f(base.limit(0), batch, ["id"], "seq"))) == 3


def test_upsert_folds_repeated_keys(base, spark, monkeypatch):
    batch = spark.createDataFrame([(2, "B", 1, 1), (2, "BB", 2, 2), (3, "c", 7, 1), (3, "cc", 8, 2), (3, "cc", 8, 2), (3, "d", None, 0), (4, None, 1, 1), (4, "x", None, 2)], "id int, name string, v int, seq int")
    plus = dml.upsert(base, batch.where("seq > 0"), ["id"], "seq", {"v": dml.Plus(F.col("new.v"))})
    assert rows(plus) == sorted([(1, "a", 10), (2, "b", 23), (3, "c", 23), (4, None, None), (None, "n", 0)], key=str)
    assert rows(dml.upsert(base, batch, ["id"], "seq", {"v": F.col("new.v") * 10, "name": F.col("new.name")})) == sorted([(1, "a", 10), (2, "BB", 20), (3, "cc", 80), (4, "x", None), (None, "n", 0)], key=str)
    both = {"v": lambda old, new: F.coalesce(old["v"], F.lit(0)) * 2 + F.coalesce(new["v"], F.lit(0)), "name": lambda old, new: F.concat_ws("/", old["name"], new["name"], old["v"].cast("string"))}
    assert rows(dml.upsert(base, batch, ["id"], "seq", both)) == sorted([(1, "a", 10), (2, "b/B/41/BB/84", 84), (3, "d/c/7/cc/22/cc/52", 52), (4, "x/2", 2), (None, "n", 0)], key=str)
    assert rows(dml.upsert(base, batch.limit(0), ["id"], "seq", both)) == rows(base) and len(rows(dml.upsert(base.limit(0), batch, ["id"], "seq", both))) == 3
    with pytest.raises(ValueError):
        dml.upsert(base, batch, ["id"], "seq", {"v": F.col("old.v") + 1})
    monkeypatch.setattr(dml, "FOLD_ROWS", 3)
    with pytest.raises(dml.TooManyRepeats):
        dml.upsert(base, batch, ["id"], "seq", both)


def test_update_join_with_repeated_partners(base, spark):
    o = spark.createDataFrame([(2, "zz", 1), (2, "aa", 2), (2, "aa", 2), (None, "q", 0)], "id int, w string, at int")
    assert rows(dml.update_join(base, o, ["id"], {"name": F.col("o.w")})) == sorted([(1, "a", 10), (2, "aa", 20), (None, "n", 0)], key=str)
    assert rows(dml.update_join(base, o, ["id"], {"name": F.col("o.w")}, [F.col("at")])) == sorted([(1, "a", 10), (2, "zz", 20), (None, "n", 0)], key=str)


def test_update_and_delete(base):
    assert rows(dml.update(base, {"v": F.col("v") + 100, "id": F.col("v")})) == sorted([(110, "a", 110), (120, "b", 120), (100, "n", 100)], key=str)
    assert rows(dml.update(base, {"v": F.lit(1)}, F.col("id") > 1)) == sorted([(1, "a", 10), (2, "b", 1), (None, "n", 0)], key=str)
    assert rows(dml.delete(base, F.col("id") > 1)) == sorted([(1, "a", 10), (None, "n", 0)], key=str)
    assert rows(dml.update_limit(base, {"v": F.lit(-1)}, F.lit(True), [F.asc("v")], 1, ["id"])) == sorted([(1, "a", 10), (2, "b", 20), (None, "n", -1)], key=str)
    assert rows(dml.delete_limit(base, F.col("v") >= 0, [F.desc("v")], 2, ["id"])) == [(None, "n", 0)]
    assert dml.truncate(base).count() == dml.create_like(base).count() == 0


def test_update_ignore(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id int")
    assert rows(dml.update_ignore(df, "id", F.col("id") + 1)) == [(1,), (10,), (2,), (4,)]


def test_update_and_delete_join(base, spark):
    o = spark.createDataFrame([(2, "zz"), (None, "q"), (8, "y")], "id int, w string")
    assert rows(dml.update_join(base, o, ["id"], {"name": F.col("o.w")})) == sorted([(1, "a", 10), (2, "zz", 20), (None, "n", 0)], key=str)
    assert rows(dml.delete_join(base, o, ["id"])) == sorted([(1, "a", 10), (None, "n", 0)], key=str)
    assert rows(dml.delete_join(base, o, ["id"], matching=False)) == [(2, "b", 20)]


def test_guards(base, spark):
    dml.require_unique(base, ["id"])
    with pytest.raises(dml.DuplicateKey):
        dml.require_unique(base.union(base), ["id"])
    with pytest.raises(dml.CheckFailed):
        dml.insert_through_view(base, base, F.col("v") > 5)
    with pytest.raises(dml.CheckFailed):
        dml.require_check(base, F.col("v") > 5)
    assert rows(dml.auto_increment(base, spark.createDataFrame([("x", 1), ("w", 2)], "name string, v int"), "id", [F.asc("v")])) == sorted([*map(tuple, base.collect()), (3, "x", 1), (4, "w", 2)], key=str)


def test_not_in_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "a int")
    b = spark.createDataFrame([(1,), (3,), (3,)], "b int")
    assert rows(rel.not_in(a, "a", b, "b")) == [(2,), (4,)]
    assert rows(rel.not_in(a, "a", b.union(spark.createDataFrame([(None,)], "b int")), "b")) == []
    assert len(rows(rel.not_in(a, "a", b.limit(0), "b"))) == 5


def test_numbering_is_dense_and_ordered(spark):
    r = random.Random(1)
    data = [(r.choice([None, *range(40)]), i) for i in range(500)]
    df = spark.createDataFrame(data, "k int, i int").repartition(7)
    got = numbering.number_rows(df, [F.asc("k"), F.asc("i")]).collect()
    want = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(x.k, x.i) for x in sorted(got, key=lambda x: x.row_no)] == want and sorted(x.row_no for x in got) == [*range(1, 501)]
    ranks = {x.k: x.group_id for x in numbering.dense_ranks(df, "k").collect()}
    assert ranks == {k: n + 1 for n, k in enumerate(sorted({k for k, _ in data}, key=lambda k: (k is not None, k or 0)))}
    assert numbering.number_rows(df.limit(0), [F.asc("k")]).count() == 0


@pytest.mark.parametrize("group_rows", [0, 10**6])
def test_along_groups(spark, group_rows):
    r = random.Random(6)
    data = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([None, *range(50)]), i, r.choice([None, 1, 2, 5])) for i in range(700)]
    df = spark.createDataFrame(data, "k string, t int, i int, v int").repartition(6)
    got = {x.i: (x.no, x.s, x.p) for x in along(df, "k", ["t", "i"], number="no", total=("v", "s"), previous=("v", "p"), group_rows=group_rows).collect()}
    want = {}
    for k in {x[0] for x in data}:
        total, prev = None, None
        for n, x in enumerate(sorted((x for x in data if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))):
            total = total if x[3] is None else (total or 0) + x[3]
            want[x[2]] = (n + 1, total, prev)
            prev = x[3]
    assert got == want
    assert along(df.limit(0), "k", ["t", "i"], number="no", group_rows=group_rows).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_outer", "right_outer", "full_outer", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).cast("int").alias("k"), "id").union(spark.createDataFrame([(None, -1)], "k int, id long"))
    small = spark.createDataFrame([(i, f"n{i}") for i in range(0, 60, 2)] + [(1, "one"), (None, "null")], "k int, name string")
    small = small.union(spark.createDataFrame([(99, "none"), (99, "none")], "k int, name string"))
    assert rows(rel.spread_join(big, small, "k", how)) == rows(big.join(small, "k", how))
    assert rows(rel.spread_join(big.limit(0), small, "k", how)) == rows(big.limit(0).join(small, "k", how))
    assert rows(rel.spread_join(big, small.limit(0), "k", how)) == rows(big.join(small.limit(0), "k", how))


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_not_in_range_equals_brute_force(spark, op):
    import operator

    within, r = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op], random.Random(3)
    some = lambda n, nulls: [(None if r.random() < nulls else r.randrange(7), r.choice([None, *range(7)])) for _ in range(n)]
    left = some(80, 0.2)
    for right in (some(5, 0.2), some(4, 0.0), []):
        lists = [([k for k, b in right if b is not None and x is not None and within(b, x)], row) for row in left for x in (row[1],)]
        want = [row for keys, row in lists if not keys or (row[0] is not None and None not in keys and row[0] not in keys)]
        got = rel.not_in_range(spark.createDataFrame(left, "k int, b int"), "k", "b", spark.createDataFrame(right, "k int, b int"), "k", "b", op)
        assert rows(got) == sorted(want, key=str) and got.columns == ["k", "b"]


def test_order_of_a_straight_join_and_side_of_a_hash_join(spark):
    t = [spark.range(n).select(F.col("id").alias(f"k{i}")) for i, n in enumerate((50, 4000, 3, 700))]
    j = rel.straight_join(t[0], (t[1], F.col("k0") == F.col("k1")), (t[2], F.col("k1") == F.col("k2"), "left"), (t[3], F.col("k1") == F.col("k3")))
    plan = j._jdf.queryExecution().optimizedPlan().toString()
    assert [int(n) for n in re.findall(r"Range \(0, (\d+)", plan)] == [50, 4000, 3, 700] and j.count() == 50
    one, two = spark.range(10).toDF("k"), spark.range(100_000).toDF("k")
    for a, b in ((one, two), (two, one)):
        h = rel.hash_join(a, b, ["k"])
        assert h.count() == 10 and ("BuildLeft" if a is one else "BuildRight") in h._jdf.queryExecution().executedPlan().toString()


def test_group_concat_of_large_groups(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v")).union(spark.createDataFrame([(9, None)], "g long, v long"))
    got = {r["g"]: r["t"] for r in rel.group_concat_limited(df, ["g"], "v", "t", max_len=30).collect()}
    assert got == {0: ",".join(str(i) for i in range(0, 5000, 2) if i % 3)[:30], 1: ",".join(str(i) for i in range(1, 5000, 2) if i % 3)[:30], 9: None}
    down = {r["g"]: r["t"] for r in rel.group_concat_limited(df, ["g"], "v", "t", "; ", [F.desc("v")], 20).collect()}
    assert down[0] == "; ".join(str(i) for i in range(4998, 0, -2) if i % 3)[:20]
    assert "WindowGroupLimit" in rel.group_concat_limited(df, ["g"], "v", "t")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        rel.group_concat_limited(df, ["g"], "v", "t", "")


def test_union_types(spark):
    f = lambda t: spark.createDataFrame([], f"a {t}")
    kind = lambda a, b: rel.union_types(f(a), f(b)).schema[0].dataType.simpleString()
    assert kind("int", "string") == "string" and kind("date", "string") == "string" and kind("int", "bigint") == "bigint"
    assert kind("decimal(17,0)", "decimal(17,17)") == "decimal(34,17)"
    with pytest.raises(ValueError):
        kind("timestamp", "int")
    with pytest.raises(ValueError):
        rel.union_types(f("int"), spark.createDataFrame([], "a int, b int"))
    with pytest.raises(ValueError):
        rel.natural_join(f("int"), spark.createDataFrame([], "b int"))


def test_match_against(spark):
    df = spark.createDataFrame([(1, "Red apple, red pear"), (2, "green apple"), (3, None), (4, "")], "i int, s string")
    assert [(r.i, r.relevance) for r in rel.match_against(df, "s", "+red").collect()] == [(1, 2)]
    assert {r.i for r in rel.match_against(df, "s", "apple pear").collect()} == {1, 2}
    assert {r.i for r in rel.match_against(df, "s", "apple -red").collect()} == {2}
    assert {r.i for r in rel.match_against(df, "s", '"apple red"').collect()} == {1} and not rel.match_against(df, "s", '+"red green"').collect()
    assert {r.i for r in rel.match_against(df, "s", "gre* +app*").collect()} == {1, 2} and not rel.match_against(df, "s", "gre").collect()
    assert [r.i for r in rel.match_against(df, "s", "red apple", ranked=True).collect()] == [1, 2]


S = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])


@pytest.mark.parametrize(("sep", "quote"), [("|", '"'), ("|", ""), ("\t", ""), (",", "'"), ("::", "")])
def test_every_text_comes_back(spark, tmp_path, sep, quote):
    odd = ["x|y", None, "", 'q"q', "it's", "two\\three", "a\nb", "c\r\nd", "nul\0z", "\\N", "\\", "\\\\n", "\\n", "tab\tx", '"', "|", "ends\\", "ü€😀", " pad ", "NULL", "\x1a\b", "a::b:", "\n" * 5000, "z" * 100_000]
    df = spark.createDataFrame([(i if i % 3 else None, v) for i, v in enumerate(odd)], S)
    delimited.export(df, str(tmp_path / "o"), sep=sep, quote=quote)
    assert rows(delimited.load(spark, str(tmp_path / "o"), S, sep=sep, quote=quote)) == rows(df)
    assert rows(delimited.load(spark, str(tmp_path / "o"), S, sep=sep, quote=quote, abort_count=0)) == rows(df)


def test_files_of_others(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text('1,"a,b"\n2,"c,""d"\n3,e\n4\n5,x,y\n6,"x",y\nz,"k"\n7,""\n8,\n')
    seen = Observation("load")
    assert rows(delimited.load(spark, str(p), S, sep=",", quote='"', seen=seen)) == [(1, "a,b"), (2, 'c,"d'), (3, "e"), (7, ""), (8, "")]
    assert seen.get == {"rows": 9, "bad": 4}
    p.write_text('1,"a\nb"\n2,"c,""d"\n3,e\n')
    assert rows(delimited.load(spark, str(p), S, sep=",", quote='"', multiline=True)) == [(1, "a\nb"), (2, 'c,"d'), (3, "e")]
    with pytest.raises(Exception, match="noncharacter"):
        delimited.export(spark.createDataFrame([("\ufdd0",)], "a string"), str(tmp_path / "n"))


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x|y"), (None, ""), (3, None), (4, 'q"q'), (5, "two\\three")], S)
    delimited.export(df, str(tmp_path / "o"), sep="|", quote='"')
    assert rows(delimited.load(spark, str(tmp_path / "o"), S, sep="|", quote='"')) == rows(df)
    delimited.export(df.limit(0), str(tmp_path / "e"))
    assert delimited.load(spark, str(tmp_path / "e"), S).count() == 0


def test_load_options_and_rejects(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_text("head\nhead2\n1,one\nx,bad\n3,\\N\n4,four\n")
    load = lambda **k: delimited.load(spark, str(p), S, sep=",", **k)
    assert rows(load(skip=2)) == [(1, "one"), (3, None), (4, "four")]
    assert rows(load(skip=2, reject_path=str(tmp_path / "bad"))) == [(1, "one"), (3, None), (4, "four")]
    assert [r.value for r in spark.read.text(str(tmp_path / "bad")).collect()] == ["x,bad"]
    with pytest.raises(delimited.TooManyRejects):
        load(skip=2, abort_count=0)
    with pytest.raises(delimited.TooManyRejects):
        load(skip=2, abort_share=0.25)
    load(skip=2, abort_count=2)
    q = tmp_path / "g.txt"
    q.write_text("7\n8\n")
    wide = T.StructType([*S.fields, T.StructField("c", T.IntegerType())])
    assert rows(delimited.load(spark, str(q), wide, columns=["a"], defaults={"b": F.lit("d")}, set_={"c": F.col("a") * 2})) == [(7, "d", 14), (8, "d", 16)]


def test_cursor_and_query_builder(spark):
    df = spark.range(10).repartition(3)
    c = Cursor(df, [F.desc("id")])
    assert [sorted(r.id for r in c.fetch(4).collect()) for _ in range(4)] == [[6, 7, 8, 9], [2, 3, 4, 5], [0, 1], []]
    c.rewind()
    assert c.fetch(1).first().id == 9 and Cursor(df.limit(0), [F.asc("id")]).fetch(3).count() == 0
    q = Query(df).where("id", "gt", "a").where("id", "in", "b").order("id", descending=True)
    assert [r.id for r in q.limit(2).run(a=3, b=[1, 5, 7, 9]).collect()] == [9, 7] and q.run(a=100, b=[1]).count() == 0
    assert Query(df).where("id", "between", "x", "y").run(x=2, y=4).count() == 3 and Query(df).where("id", "isnull").run().count() == 0
    for bad in (lambda: Query(df).where("id", "like", "a"), lambda: q.run(a=1), lambda: Query(df).run(a=1)):
        with pytest.raises(ValueError):
            bad()


def test_no_local_folder_off_this_machine():
    from types import SimpleNamespace

    from millrace.session import local_folder

    assert local_folder(SimpleNamespace(sparkContext=SimpleNamespace(master="local[2]")))
    with pytest.raises(ValueError):
        local_folder(SimpleNamespace(sparkContext=SimpleNamespace(master="spark://x:7077")))
