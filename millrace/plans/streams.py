"""Windows over event time; additions that the reference does not have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.plans.registry import Catalogue
from millrace.session import cut
from millrace.sources.files import children, is_folder, remove, shared_dir
from millrace.streaming import windows as W

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


@C.add("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return W.tumbling(t.events, "ts", "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@C.add("sliding_counts", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY s")
def _(t):
    return W.sliding(t.events, "ts", "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@C.add(
    "session_windows",
    """WITH f AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(t):
    return W.sessions(t.events, "ts", "6 hours", "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _stream(t, name: str):
    """The table's file or files as a stream."""
    path = f"{t.dir}/{name}.parquet"
    schema = t.spark.read.parquet(path).schema
    if is_folder(t.spark, path):
        return t.spark.readStream.schema(schema).parquet(path)
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.dir)


def _ran(t, df, mode: str):
    """What a stream over all that is there now has put out: every batch, or in complete mode the last."""
    work = shared_dir(t.spark)
    W.run_once(df, lambda b, n: b.write.mode("overwrite").parquet(f"{work}/out/{n}"), f"{work}/state", mode=mode)
    batches = sorted(map(int, children(t.spark, f"{work}/out")))
    out = cut(t.spark.read.parquet(*(f"{work}/out/{n}" for n in (batches[-1:] if mode == "complete" else batches))))
    remove(t.spark, work)
    return out


@C.add("watermark_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def _(t):
    twice = _stream(t, "events").unionByName(_stream(t, "events")).where("event_id IS NOT NULL").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return _ran(t, W.deduplicate(twice, ["event_id"], "ts"), "append").agg(F.count(F.lit(1)).alias("n"))


@C.add("stream_tumbling_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    work = shared_dir(t.spark)
    counts = W.tumbling(_stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "event_type", late="1 hour")
    W.run_once(counts, lambda b, n: b.write.mode("overwrite").parquet(f"{work}/out/{n}"), f"{work}/state", mode="complete")
    last = max(map(int, children(t.spark, f"{work}/out")))
    out = cut(t.spark.read.parquet(f"{work}/out/{last}").withColumn("start", F.col("start").cast("timestamp_ntz")))
    remove(t.spark, work)
    return out


@C.add("stream_upsert_latest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(t):
    work = shared_dir(t.spark)
    W.run_once(_stream(t, "events").select("user_id", "event_id"), W.upsert_sink(f"{work}/out", ["user_id"], "event_id"), f"{work}/state")
    kept = W.read_upserted(t.spark, f"{work}/out")
    out = cut(kept if kept is not None else t.events.select("user_id", "event_id").limit(0))
    remove(t.spark, work)
    return out


@C.add("stream_static_join", "SELECT event_type, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY event_type")
def _(t):
    joined = _stream(t, "events").join(t.customer.select("c_custkey"), F.col("user_id") == F.col("c_custkey"))
    return _ran(t, joined.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")


@C.add("stream_sliding_counts", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY s")
def _(t):
    e = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _ran(t, W.sliding(e, "ts", "1 hour", "30 minutes", late="1 hour"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@C.add("stream_session_windows", ORACLES["session_windows"])
def _(t):
    e = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _ran(t, W.sessions(e, "ts", "6 hours", "user_id", late="1 hour"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@C.add("stream_late_rows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-11' OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 2 HOUR FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-20') GROUP BY 1")
def _(t):
    # three deliveries, the oldest days last: by then the watermark is two hours behind the newest event
    # of the first, and late days are dropped
    work = shared_dir(t.spark)
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    at = lambda day: F.coalesce(F.col("ts") >= F.lit(day).cast("timestamp"), F.lit(False))
    for part in (at("2024-01-11") & ~at("2024-01-20"), at("2024-01-20"), ~at("2024-01-11")):
        e.where(part).repartition(1).write.mode("append").parquet(f"{work}/in")
    stream = t.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    W.run_once(W.tumbling(stream, "ts", "1 day", late="2 hours"), lambda b, n: b.write.mode("overwrite").parquet(f"{work}/out/{n}"), f"{work}/state", mode="update")
    batches = sorted(map(int, children(t.spark, f"{work}/out")))
    parts = [t.spark.read.parquet(f"{work}/out/{n}").withColumn("b", F.lit(n)) for n in batches]
    newest = reduce(lambda x, y: x.unionByName(y), parts).groupBy("start").agg(F.max_by("n", "b").alias("n"))
    out = cut(newest.withColumn("start", F.col("start").cast("timestamp_ntz")))
    remove(t.spark, work)
    return out
