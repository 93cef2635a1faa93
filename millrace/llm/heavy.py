"""p3: most frequent items, three-phase threshold top-k over bounded local summaries.

Phase 1: every node (a shuffle partition of the distinct (item, record) pairs) keeps its local counts
as a Misra-Gries summary of fixed capacity and sends its local leaders; their summed counts are lower
bounds, and the k-th of them is a lower bound of the k-th count (where a share of all pairs is asked
for, that share is the bound, if it is larger). Phase 2: an item that reaches the bound has at least
the bound's part, bound / nodes, on some node; every node sends the items that may have so many, and
those whose summed upper bound misses the bound fall away. Phase 3: only rows of the remaining items
are read again, made distinct and counted exactly.

Several fields are counted in one pass. Where a node's summary is too small to hold all items above
the bound's part, all items are counted exactly by a plain aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.names import plain
from millrace.session import cut
from millrace.sources.tables import table

#: Counters that a node keeps; memory of a node is bounded by this and one Arrow batch.
CAPACITY = 4000
#: Items that may be broadcast in phase 3; above it they are joined by a shuffle.
BROADCAST_ITEMS = 20_000


def _trim(counts: dict[str, int], capacity: int) -> tuple[dict[str, int], int]:
    """Misra-Gries merge step: lowers all counters by the (capacity+1)-th largest."""
    if len(counts) <= capacity:
        return counts, 0
    v = int(-np.partition(-np.fromiter(counts.values(), np.int64, len(counts)), capacity)[capacity])
    return {k: c - v for k, c in counts.items() if c > v}, v


def summarise(capacity: int, k: int = 0):
    """A mapInArrow function: batches of (field, item, ...) to one summary of each field: rows (field, item, lower, leads, err, n).

    ``leads`` marks the ``k`` largest counters, ``err`` bounds what any item's count on this node may lack,
    ``n`` is the number of the node's rows, in the row without an item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, int]] = {}
        err: dict[str, int] = {}
        n: dict[str, int] = {}
        for b in batches:
            for f in pc.unique(b.column(0)).to_pylist():  # few fields
                own = b.column(1).filter(pc.equal(b.column(0), f))
                have, fresh = counts.setdefault(f, {}), pc.value_counts(own)
                for item, c in zip(fresh.field(0).to_pylist(), fresh.field(1).to_pylist(), strict=True):
                    have[item] = have.get(item, 0) + c
                counts[f], v = _trim(have, capacity)
                err[f] = err.get(f, 0) + v
                n[f] = n.get(f, 0) + len(own)
        for f, have in counts.items():
            m, lower = len(have), np.fromiter(have.values(), np.int64, len(have))
            leads = np.zeros(m, bool)
            leads[np.argsort(-lower, kind="stable")[:k]] = True
            yield pa.RecordBatch.from_pydict(
                {"field": pa.array([f] * (m + 1), pa.string()), "item": pa.array([None, *have], pa.string()), "lower": pa.array([0, *lower.tolist()], pa.int64()), "leads": pa.array([False, *leads.tolist()], pa.bool_()), "err": pa.array([err[f]] * (m + 1), pa.int64()), "n": pa.array([n[f]] + [0] * m, pa.int64())}
            )

    return run


def pairs_of(df: DataFrame, item: str, record: str) -> DataFrame:
    """(item, record) with the item's plain form; null items, empty plain forms and null records are left out."""
    return df.select(plain(item).alias("item"), F.col(record).alias("record")).where((F.col("item") != "") & F.col("record").isNotNull())


def _by_field(values: dict[str, int]) -> Column:
    """The number of the row's field."""
    out = F.lit(None).cast("long")
    for f, v in values.items():
        out = F.when(F.col("field") == f, F.lit(v).cast("long")).otherwise(out)
    return out


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.distinct().groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))


def threshold_search(pairs: DataFrame, k: int, capacity: int, bound_of: Callable[[int, int], int]) -> tuple[DataFrame, DataFrame, dict[str, int], dict[str, int]]:
    """Exact counts of all items of (field, item, record) that reach their field's bound.

    ``bound_of(n, leader)``: the bound, from the number of distinct pairs and the k-th leader's
    summed count. Gives (field, item, n), the summed summaries (field, item, lower), and by field
    the bounds and what a count may exceed ``lower`` by. Other items may come out too.
    """
    local = cut(pairs.distinct().mapInArrow(summarise(capacity, k), "field string, item string, lower long, leads boolean, err long, n long"))
    held = local.where(F.col("item").isNotNull())
    # phase 1: local leaders are exchanged
    sums = held.where("leads").groupBy("field", "item").agg(F.sum("lower").alias("lower"))
    leader = sums.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("lower"), "item"))).where(F.col("r") == k).select("field", F.col("lower").alias("leader"))
    facts = local.where(F.col("item").isNull()).groupBy("field").agg(F.sum("n").alias("n"), F.sum("err").alias("err"), F.max("err").alias("most"), F.count(F.lit(1)).alias("nodes"))
    rows = facts.join(leader, "field", "left").collect()  # one row for each field
    bounds = {r["field"]: max(1, bound_of(r["n"], r["leader"] or 0)) for r in rows}
    err = {r["field"]: r["err"] for r in rows}
    summed = held.groupBy("field", "item").agg(F.sum("lower").alias("lower"))
    if any(r["most"] * r["nodes"] >= bounds[r["field"]] for r in rows):
        return _counted(pairs), summed, bounds, err
    # phase 2: items that may have the bound's part on a node, and whose upper bound reaches the bound
    above = F.max((F.col("lower") + F.col("err")) * _by_field({r["field"]: r["nodes"] for r in rows}) >= _by_field(bounds))
    candidates = held.groupBy("field", "item").agg(F.sum("lower").alias("lower"), above.alias("above"))
    keys = cut(candidates.where(F.col("above") & (F.col("lower") + _by_field(err) >= _by_field(bounds))).select("field", "item"))
    # phase 3: their rows are read again
    few = keys.count() <= BROADCAST_ITEMS
    return _counted(pairs.join(F.broadcast(keys) if few else keys, ["field", "item"], "left_semi")), summed, bounds, err


def frequent_fields(pairs: DataFrame, share: int = 200, least: int = 10, capacity: int = CAPACITY) -> DataFrame:
    """(field, item, n) of the items that hold at least 1/``share`` of their field's distinct pairs and at least ``least`` of them."""
    if capacity <= share:
        raise ValueError("capacity must exceed share")
    counted, _, bounds, _ = threshold_search(pairs, share, capacity, lambda n, leader: max(-(-n // share), least, leader))
    return counted.where(F.col("n") >= _by_field(bounds))


def top_fields(pairs: DataFrame, k: int = 50, capacity: int = CAPACITY) -> DataFrame:
    """(field, item, lower, upper, n) of the ``k`` most frequent items of each field, ties at the last place included."""
    counted, summed, _, err = threshold_search(pairs, k, capacity, lambda n, leader: leader)
    # the limit with ties: the k-th count of a field; the plan ranks before the shuffle, so no task gets all items
    last = counted.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "item"))).where(F.col("r") <= k).groupBy("field").agg(F.min("n").alias("least"))
    best = counted.join(F.broadcast(last), "field").where(F.col("n") >= F.col("least"))
    lower = F.coalesce("lower", F.lit(0))
    return best.join(summed, ["field", "item"], "left").select("field", "item", lower.alias("lower"), (lower + _by_field(err)).alias("upper"), "n")


def frequent_share(df: DataFrame, item: str, record: str, share: int = 200, least: int = 10, capacity: int = CAPACITY) -> DataFrame:
    """Items that hold at least 1/``share`` of the distinct pairs and at least ``least`` of them.

    Columns: item, n (exact). Repeated rows count once; an empty table gives no row; items at
    exactly the threshold are kept. ``capacity`` must exceed ``share``.
    """
    return frequent_fields(pairs_of(df, item, record).select(F.lit("").alias("field"), "item", "record"), share, least, capacity).drop("field")


def top_k(df: DataFrame, item: str, record: str, k: int = 50, capacity: int = CAPACITY) -> DataFrame:
    """The ``k`` most frequent items by distinct pairs, ties at the last place included.

    Columns: item, lower and upper (bounds from the summaries), n (exact). Where there are fewer
    than ``k`` items, all come out.
    """
    return top_fields(pairs_of(df, item, record).select(F.lit("").alias("field"), "item", "record"), k, capacity).drop("field")


_FIELDS = (("hashtag", "hashtag"), ("mention", "at_user"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    parts = [pairs_of(table(spark, d, t), c, "tweet_id").select(F.lit(c).alias("field"), "item", "record") for t, c in _FIELDS]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_fields(_pairs(spark, d)).select("field", "item")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The items of p3_found with their exact counts."""
    return frequent_fields(_pairs(spark, d))


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most used tags and most mentioned names (ties included) with exact counts."""
    return top_fields(_pairs(spark, d)).select("field", "item", "n")


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The same with the bounds that the summaries alone give for each count."""
    return top_fields(_pairs(spark, d))


def _sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS field, item, count(*) AS n FROM (
        SELECT DISTINCT lower(trim(regexp_replace(trim({c}), '^[@#]+', ''))) AS item, tweet_id FROM {t} WHERE tweet_id IS NOT NULL)
        WHERE item <> '' GROUP BY item"""


_SHARE = " UNION ALL ".join(f"SELECT * FROM (SELECT *, sum(n) OVER () AS total FROM ({_sql(t, c)})) WHERE n * 200 >= total AND n >= 10" for t, c in _FIELDS)
QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts, "p3_top": p3_top, "p3_bounds": p3_bounds}
ORACLES = {
    "p3_found": f"SELECT field, item FROM ({_SHARE})",
    "p3_counts": f"SELECT field, item, n FROM ({_SHARE})",
    "p3_top": " UNION ALL ".join(f"SELECT field, item, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM ({_sql(t, c)})) WHERE r <= 50" for t, c in _FIELDS),
}
