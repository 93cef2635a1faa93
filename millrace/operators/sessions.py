"""Sessions: stretches of activity separated by gaps.

The textbook plan (window over the user, lag, running sum) puts all rows of a user into one
task. Here the user's time line is cut into buckets first: the lag and the running sum run
inside (user, bucket), and one summary row for each bucket carries the last time and the
number of breaks over the borders. A user with a third of all rows is thus spread over as
many tasks as the time line has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_deliveries(events: DataFrame, key: str, user: Column, at: str) -> DataFrame:
    """One row for each key: its smallest non-null user and its earliest non-null time.

    Columns of the result: _id, _user, _at. Keys without user or time are left out, as are
    null keys. An empty user is a user like any other.
    """
    return (
        events.select(F.col(key).alias("_id"), user.alias("_user"), F.col(at).alias("_at"))
        .where(F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(F.min("_user").alias("_user"), F.min("_at").alias("_at"))
        .where(F.col("_user").isNotNull() & F.col("_at").isNotNull())
    )


def sessionize(events: DataFrame, user: str, at: str, order: str, gap: str = "30 minutes", bucket: str = "6 hours") -> DataFrame:
    """One row for each session of ``user``.

    Rows are ordered by (``at``, ``order``); a row more than ``gap`` after the one before it
    starts a session, a row exactly ``gap`` after it does not. Columns: user_key, session_no
    (from 1), first_id, last_id, start_at, end_at, duration_s, n_events.

    Rows with a null user or time are left out; a null ``order`` comes before any other. Ties
    and repeated rows count as events with a distance of 0. An empty input gives no row, and
    other columns of the input are not read. ``bucket`` only sets how a user's rows are spread
    over tasks; it has no effect on the result.
    """
    row = F.struct(F.col(at).cast("timestamp_ntz").alias("t"), F.col(order).alias("i"))
    width = F.expr(f"INTERVAL '{bucket}'")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    wide = F.unix_micros(F.lit(0).cast("timestamp") + width)
    breaks_after = lambda a, b: (b > a + F.expr(f"INTERVAL '{gap}'")).cast("long")
    rows = (
        events.select(F.col(user).alias("u"), row.alias("r"))
        .where(F.col("u").isNotNull() & F.col("r.t").isNotNull())
        .withColumn("b", F.floor(micros(F.col("r.t")) / wide))
    )
    inside = Window.partitionBy("u", "b").orderBy("r")
    local = rows.withColumn("_brk", F.coalesce(breaks_after(F.lag("r.t").over(inside), F.col("r.t")), F.lit(0).cast("long"))).withColumn(
        "k", F.sum("_brk").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    parts = local.groupBy("u", "b", "k").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("u").orderBy("b")
    buckets = (
        parts.groupBy("u", "b")
        .agg(F.min("lo.t").alias("first"), F.max("hi.t").alias("last"), F.max("k").alias("breaks"))
        .withColumn("head", F.coalesce(breaks_after(F.lag("last").over(along), F.col("first")), F.lit(1).cast("long")))
        .withColumn("base", F.sum(F.col("head") + F.coalesce(F.lag("breaks").over(along), F.lit(0).cast("long"))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .select("u", "b", "base")
    )
    return (
        parts.join(buckets, ["u", "b"])
        .groupBy("u", (F.col("base") + F.col("k")).alias("session_no"))
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n_events"))
        .select(
            F.col("u").alias("user_key"),
            "session_no",
            F.col("lo.i").alias("first_id"),
            F.col("hi.i").alias("last_id"),
            F.col("lo.t").alias("start_at"),
            F.col("hi.t").alias("end_at"),
            ((micros(F.col("hi.t")) - micros(F.col("lo.t"))) / 1e6).alias("duration_s"),
            "n_events",
        )
    )
