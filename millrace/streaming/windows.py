"""Windows over event time. Each works on a stream and on a table alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import children, is_folder


def tumbling(events: DataFrame, at: str, size: str, *keys: str, late: str | None = None) -> DataFrame:
    """Events of each window [start, end) and key. Null times are in no window."""
    e = events.withWatermark(at, late) if late and events.isStreaming else events
    return e.groupBy(F.window(at, size), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, at: str, size: str, slide: str, *keys: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark(at, late) if late and events.isStreaming else events
    return e.groupBy(F.window(at, size, slide), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    """Session windows: an event within ``gap`` of the one before belongs to its session."""
    e = events.withWatermark(at, late) if late and events.isStreaming else events
    return e.groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("session_window.start").alias("start"), "n")


def deduplicate(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """One event for each key; on a stream, keys are forgotten ``late`` after the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, batch by batch, and stops."""
    df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def _latest(spark: SparkSession, path: str, before: int | None = None) -> dict[str, int]:
    """The newest version of each bucket: folder name to version."""
    newest: dict[str, int] = {}
    for v in children(spark, path) if is_folder(spark, path) else []:
        n = int(v[2:]) if v.startswith("v=") else -1
        if n >= 0 and (before is None or n < before):
            for b in children(spark, f"{path}/{v}"):
                if b.startswith("b="):
                    newest[b] = max(n, newest.get(b, -1))
    return newest


def read_upserted(spark: SparkSession, path: str, before: int | None = None, buckets: set[str] | None = None) -> DataFrame | None:
    """The table that ``upsert_sink`` maintains, or None while it has no rows."""
    parts = [f"{path}/v={n}/{b}" for b, n in _latest(spark, path, before).items() if buckets is None or b in buckets]
    return spark.read.parquet(*parts) if parts else None


def upsert_sink(path: str, key: list[str], seq: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: merges each micro-batch into a parquet table by key, the largest ``seq`` counts.

    The table is cut into buckets of the key; a batch reads and rewrites only the buckets that it
    touches, as new versions (``v=<batch>/b=<bucket>``) beside the old ones, and readers take the
    newest of each. A batch that runs again after a failure reads what was there before it and
    overwrites its own version, so the result is the same. Old versions may be removed at any time.
    """

    def sink(batch: DataFrame, number: int) -> None:
        from millrace.operators.dml import last_of

        spark = batch.sparkSession
        at = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        touched = {f"b={r['b']}" for r in batch.select(at.alias("b")).distinct().collect()}  # at most ``buckets`` rows
        if not touched:
            return
        old = read_upserted(spark, path, number, touched)
        merged = last_of(old.unionByName(batch) if old is not None else batch, key, seq)
        merged.withColumn("b", at).write.mode("overwrite").partitionBy("b").parquet(f"{path}/v={number}")

    return sink
