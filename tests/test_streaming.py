"""Windows and sinks on streams and on tables."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.plans import streams
from millrace.streaming import windows as W

T0 = dt.datetime(2024, 1, 1)
ROWS = [(1, "a", T0), (2, "a", T0 + dt.timedelta(minutes=9)), (3, "b", T0 + dt.timedelta(minutes=20)), (4, "a", T0 + dt.timedelta(minutes=40)), (4, "a", T0 + dt.timedelta(minutes=40)), (5, None, None)]


def frame(spark):
    return spark.createDataFrame(ROWS, "id int, k string, at timestamp")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_windows_on_a_table(spark):
    df = frame(spark)
    assert rows(W.tumbling(df, "at", "30 minutes").select("n")) == [(2,), (3,)]
    assert sum(r["n"] for r in W.sliding(df, "at", "20 minutes", "10 minutes").collect()) == 10
    assert rows(W.sessions(df, "at", "10 minutes", "k").select("k", "n")) == [("a", 2), ("a", 2), ("b", 1)]
    assert W.deduplicate(df, ["id"], "at").count() == 5
    assert W.tumbling(df.limit(0), "at", "1 hour").count() == 0



def test_upsert_sink_over_batches_and_reruns(spark, tmp_path):
    path = str(tmp_path)
    sink = W.upsert_sink(f"{path}/out", ["user"], "seq", buckets=4)
    one = spark.createDataFrame([(i, 1, "x") for i in range(20)] + [(None, 1, "n")], "user int, seq int, v string")
    two = spark.createDataFrame([(3, 2, "y"), (3, 3, "z"), (99, 1, "w"), (5, 0, "late")], "user int, seq int, v string")
    for df, n in ((one, 0), (two, 1), (two, 1), (two.limit(0), 2)):
        sink(df, n)
    got = {r["user"]: (r["seq"], r["v"]) for r in W.read_upserted(spark, f"{path}/out").collect()}
    assert len(got) == 22 and got[3] == (3, "z") and got[99] == (1, "w") and got[5] == (1, "x") and got[None] == (1, "n")
    assert W.read_upserted(spark, f"{path}/none") is None


def test_stream_with_watermark(spark, tmp_path):
    frame(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark).schema).parquet(str(tmp_path / "in"))
    got = []
    W.run_once(W.tumbling(stream, "at", "30 minutes", late="10 minutes"), lambda b, n: got.extend(r["n"] for r in b.collect()), str(tmp_path / "state"), mode="complete")
    assert sorted(got)[-2:] == [2, 3]
    seen = []
    W.run_once(W.deduplicate(stream.where(F.col("at").isNotNull()), ["id"], "at"), lambda b, n: seen.extend(r["id"] for r in b.collect()), str(tmp_path / "state2"))
    assert sorted(seen) == [1, 2, 3, 4]


def test_queries_run_as_streams(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 7, "a", T0), (1, 7, "a", T0), (2, 8, "b", T0 - dt.timedelta(days=3)), (None, 7, "b", None)], "event_id long, user_id long, event_type string, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(7,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    streamed, run = [], W.run_once
    monkeypatch.setattr(W, "run_once", lambda df, *a, **k: (streamed.append(df.isStreaming), run(df, *a, **k)))
    assert rows(streams.QUERIES["watermark_dedup"](spark, str(tmp_path))) == [(2,)]
    assert rows(streams.QUERIES["stream_static_join"](spark, str(tmp_path))) == [("a", 2), ("b", 1)]
    assert streamed == [True, True]
