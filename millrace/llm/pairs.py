"""p2: items that appear together, as a blocked Gram matrix.

Baskets become rows of a binary sparse matrix X. Rows are cut into record blocks and, where a
basket is large, into item blocks: a basket of m items is cut into ceil(m / BLOCK) item blocks, and
each pair of blocks is one unit of work with at most about (2 * BLOCK) items, so no basket is ever
gathered in one task. For each record block the transposed matrix is multiplied by the matrix, item
by item (for two item blocks the one's transpose by the other), PRODUCTS terms at a time, so the
memory of a task is bounded; only summed counts are shuffled. Counts are then normalised by the
expected marginals.

Items are pruned exactly before: a pair with n_ab >= least needs n_a >= least and n_b >= least,
and n_ab * n >= lift * n_a * n_b together with n_ab <= min(n_a, n_b) needs lift * max(n_a, n_b)
<= n, so neither rare nor very common items (a tag on a third of all records) can be in a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.heavy import pairs_of
from millrace.session import cut
from millrace.sources.tables import table

#: Items of a basket in one item block.
BLOCK = 256
#: Entries of a record block, and terms of its product that are summed at a time (they bound a task's memory).
ENTRIES, PRODUCTS = 250_000, 1_000_000
#: Items above this share of all rows are few (at most its inverse) and joined by broadcast.
HOT_SHARE = 1000
#: Items that can be in a pair are broadcast up to this number, checked before; above it only hot ones are.
BROADCAST_ITEMS = 200_000


def transpose_product(codes: np.ndarray, start: np.ndarray, length: np.ndarray, right: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(low * width + high, n) of the product of the transpose of a sparse matrix by another one.

    ``codes``: the item of each entry of the first matrix; its record's row of the second one is
    ``right[start : start + length]``. Entries are taken item by item (that is the transpose), and
    their terms are summed PRODUCTS at a time; a pair at a border of two sums comes out in both.
    """
    order = np.argsort(codes, kind="stable")
    codes, start, length = codes[order], start[order], length[order]
    ends = np.cumsum(length)
    at = 0
    while at < len(codes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PRODUCTS, side="right")))
        n = length[at:to]
        terms = int(n.sum())
        if terms:
            a = np.repeat(codes[at:to], n)
            b = right[np.arange(terms) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:to], n)]
            yield np.unique(np.minimum(a, b) * width + np.maximum(a, b), return_counts=True)
        at = to


def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (items list<string>, second list<string>) to summed (tag_a, tag_b, n).

    Where ``second`` is empty, the pairs inside ``items``; else the pairs across the two.
    """

    def flush(blocks: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (pa.concat_arrays([b.column(c) for b in blocks]) for c in (0, 1))
        flat = pa.concat_arrays([one.flatten(), two.flatten()]).dictionary_encode()
        words, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        codes, names = rank[codes], pa.array([words[i] for i in order], pa.string())
        n1, n2 = (np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in (one, two))
        m = int(n1.sum())
        ends = np.cumsum(n1)
        later = np.repeat(ends, n1) - np.arange(m) - 1  # entries of the same row behind an entry
        across = np.repeat(n2 > 0, n1)
        start = np.where(across, np.repeat(m + np.cumsum(n2) - n2, n1), np.arange(m) + 1)
        length = np.where(across, np.repeat(n2, n1), later)
        for keys, n in transpose_product(codes[:m], start, length, codes, max(1, len(words))):
            for s in range(0, len(keys), 50_000):
                k = keys[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(k // len(words))), names.take(pa.array(k % len(words))), pa.array(n[s : s + 50_000].astype(np.int64))], ["tag_a", "tag_b", "n"])

    held, entries = [], 0
    for batch in batches:
        for s in range(0, batch.num_rows, 500):
            b = batch.slice(s, 500)
            held.append(b)
            entries += len(b.column(0).flatten()) + len(b.column(1).flatten())
            if entries > ENTRIES:
                yield from flush(held)
                held, entries = [], 0
    if held:
        yield from flush(held)


def together(df: DataFrame, item: str, record: str, least: int = 10, lift: int = 5, block: int = BLOCK) -> DataFrame:
    """Pairs of items on at least ``least`` common records with n_ab * n >= lift * n_a * n_b.

    Columns: tag_a, tag_b (tag_a < tag_b by code point), n_ab, n_a, n_b, n, lift (double).
    Items are plain forms; null items, empty plain forms and null records are left out;
    repeated rows count once; an empty table gives no row. ``lift`` must be at least 1.
    """
    base = cut(pairs_of(df, item, record).distinct())
    facts = base.groupBy("record").agg(F.count(F.lit(1)).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("rows"), F.count_if(F.col("m") > block).alias("large")).first()
    rows, n = facts["rows"] or 0, facts["n"]
    counts = base.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    kept = cut(counts.where((F.col("c") >= least) & (F.col("c") * lift <= n)))
    if kept.count() <= BROADCAST_ITEMS:
        useful = base.join(F.broadcast(kept.select("item")), "item", "left_semi")
    else:
        # hot items are at most HOT_SHARE, by pigeonhole: broadcast; rows of no other item are skewed
        hot = counts.where(F.col("c") * HOT_SHARE > rows)
        common = base.join(F.broadcast(hot.join(kept.select("item"), "item", "left_semi").select("item")), "item", "left_semi")
        rest = base.join(F.broadcast(hot.select("item")), "item", "left_anti").join(kept.where(F.col("c") * HOT_SHARE <= rows).select("item"), "item", "left_semi")
        useful = common.unionByName(rest)
    # item blocks of large baskets; sizes come from a count, not from gathered groups
    size = useful.groupBy("record").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block)
    large = size.withColumn("k", F.ceil(F.col("m") / block)).select("record", "k")
    nothing = F.array().cast("array<string>")
    if facts["large"]:  # no record has more useful items than items
        giant = F.broadcast(large) if facts["large"] <= BROADCAST_ITEMS else large
        split = useful.join(giant, "record").withColumn("b", F.pmod(F.xxhash64("item"), F.col("k")))
        small = useful.join(giant.select("record"), "record", "left_anti")
        blocks = split.groupBy("record", "b").agg(F.collect_list("item").alias("items"), F.first("k").alias("k"))
        # each block meets the blocks from its own number on: one side sends copies, the pair is one unit of work
        low = blocks.select("record", F.col("items").alias("i1"), F.col("b").alias("lo"), F.explode(F.sequence(F.col("b"), F.col("k") - 1)).alias("hi"))
        high = blocks.select("record", F.col("items").alias("i2"), F.col("b").alias("hi"))
        units = low.join(high, ["record", "hi"]).select(F.col("i1").alias("items"), F.when(F.col("lo") == F.col("hi"), nothing).otherwise(F.col("i2")).alias("second"))
    else:
        small, units = useful, None
    baskets = small.groupBy("record").agg(F.collect_list("item").alias("items")).where(F.size("items") > 1).select("items", nothing.alias("second"))
    if units is not None:
        baskets = baskets.unionByName(units.repartition("items", "second"))
    found = baskets.mapInArrow(gram, "tag_a string, tag_b string, n long").groupBy("tag_a", "tag_b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    one = kept.select(F.col("item").alias("tag_a"), F.col("c").alias("n_a"))
    two = kept.select(F.col("item").alias("tag_b"), F.col("c").alias("n_b"))
    big = lambda c: F.col(c).cast("decimal(18,0)")
    return (
        found.join(one, "tag_a")
        .join(two, "tag_b")
        .withColumn("n", F.lit(n).cast("long"))
        .where(big("n_ab") * big("n") >= big("n_a") * big("n_b") * F.lit(lift).cast("decimal(2,0)"))
        .select("tag_a", "tag_b", "n_ab", "n_a", "n_b", "n", (F.col("n_ab") * F.col("n").cast("double") / F.col("n_a") / F.col("n_b")).alias("lift"))
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return together(table(spark, d, "hashtag"), "hashtag", "tweet_id").select("tag_a", "tag_b")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their counts and lift."""
    return together(table(spark, d, "hashtag"), "hashtag", "tweet_id").withColumn("lift", F.round("lift", 4))


_SQL = """WITH b AS (SELECT DISTINCT lower(trim(regexp_replace(trim(hashtag), '^[@#]+', ''))) AS item, tweet_id FROM hashtag WHERE tweet_id IS NOT NULL),
    p AS (SELECT * FROM b WHERE item <> ''), n AS (SELECT count(DISTINCT tweet_id) AS n FROM p), c AS (SELECT item, count(*) AS c FROM p GROUP BY item),
    ab AS (SELECT x.item AS tag_a, y.item AS tag_b, count(*) AS n_ab FROM p x JOIN p y ON x.tweet_id = y.tweet_id AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 10)
    SELECT tag_a, tag_b, n_ab, a.c AS n_a, b2.c AS n_b, n.n AS n, round(n_ab * CAST(n.n AS DOUBLE) / a.c / b2.c, 4) AS lift
    FROM ab JOIN c a ON a.item = tag_a JOIN c b2 ON b2.item = tag_b CROSS JOIN n WHERE n_ab * n.n >= 5 * a.c * b2.c"""
QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs}
ORACLES = {"p2_found": f"SELECT tag_a, tag_b FROM ({_SQL})", "p2_pairs": _SQL}
