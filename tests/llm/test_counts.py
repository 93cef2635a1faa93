"""p2 and p3 against brute force, with dirt, skew and empty tables."""

import itertools
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import heavy, pairs


def norm(x):
    return x.strip(" ").lstrip("@#").strip(" ").lower()


def distinct(rows):
    return {(norm(a), b) for a, b in rows if a is not None and b is not None and norm(a)}


def make(spark, rows):
    return spark.createDataFrame(rows, "hashtag string, tweet_id long")


def brute_pairs(rows, least, lift):
    base = distinct(rows)
    baskets, holders = defaultdict(set), defaultdict(set)
    for a, b in base:
        baskets[b].add(a)
        holders[a].add(b)
    n, both = len(baskets), defaultdict(int)
    for items in baskets.values():
        for p in itertools.combinations(sorted(items), 2):
            both[p] += 1
    return {(a, b, k, len(holders[a]), len(holders[b])) for (a, b), k in both.items() if k >= least and k * n >= lift * len(holders[a]) * len(holders[b])}


def dirty(seed, n=3000):
    r = random.Random(seed)
    tags = [f"tag{i}" for i in range(40)]
    rows = []
    for i in range(n):
        t = r.randrange(600)
        g = t % 10
        tag = r.choice(tags[4 * g : 4 * g + 4]) if r.random() < 0.8 else r.choice(tags)
        rows.append((r.choice([tag, "#" + tag, tag.upper(), f" {tag} "]), t))
        if r.random() < 0.3:
            rows.append(("Hot", t))
    return rows + rows[:200] + [(None, 1), ("#", 2), ("  ", 3), ("x", None)]


@pytest.mark.parametrize(("block", "broadcast"), [(256, 10**6), (3, 10**6), (256, 0), (3, 0)])
def test_pairs_equal_brute_force(spark, block, broadcast, monkeypatch):
    monkeypatch.setattr(pairs, "BROADCAST_ITEMS", broadcast)
    monkeypatch.setattr(pairs, "HOT_SHARE", 30)
    rows = dirty(1)
    got = {(r.tag_a, r.tag_b, r.n_ab, r.n_a, r.n_b) for r in pairs.together(make(spark, rows), "hashtag", "tweet_id", 5, 2, block=block).collect()}
    assert got == brute_pairs(rows, 5, 2) and got


def test_one_basket_with_a_third_of_all_rows(spark):
    rows = dirty(2) + [(f"tag{i % 40}", 10_000 + i % 3) for i in range(400)] + [(f"big{i}", 99) for i in range(1200)] + [(f"big{i}", t) for i in range(3) for t in range(700, 712)]
    got = {(r.tag_a, r.tag_b, r.n_ab, r.n_a, r.n_b) for r in pairs.together(make(spark, rows), "hashtag", "tweet_id", 5, 2, block=16).collect()}
    assert got == brute_pairs(rows, 5, 2)
    assert ("big0", "big1", 13, 13, 13) in got


def test_pairs_of_empty_table_and_clashing_columns(spark):
    assert pairs.together(make(spark, []), "hashtag", "tweet_id").count() == 0
    df = spark.createDataFrame([("a", 1, 5, "n")], "hashtag string, tweet_id long, item int, record string")
    assert pairs.together(df, "hashtag", "tweet_id").count() == 0


def test_gram_products_across_blocks_only():
    batch = pa.RecordBatch.from_pydict({"items": pa.array([["a", "b"]], pa.list_(pa.string())), "second": pa.array([["c"]], pa.list_(pa.string()))})
    got = [tuple(r.values()) for b in pairs.gram(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == [("a", "c", 1), ("b", "c", 1)]


def test_memory_of_a_block_is_bounded():
    import tracemalloc

    rows = [[f"i{(r * 7 + j * 13) % 5000}" for j in range(512)] for r in range(300)]
    half = pa.array([x[:256] for x in rows], pa.list_(pa.string())), pa.array([x[256:] for x in rows], pa.list_(pa.string()))
    whole = pa.array(rows, pa.list_(pa.string())), pa.array([[]] * 300, pa.list_(pa.string()))
    for one, two in (half, whole):
        tracemalloc.start()
        total = sum(sum(b.column(2).to_pylist()) for b in pairs.gram(iter([pa.RecordBatch.from_arrays([one, two], ["items", "second"])])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert total == (300 * 256 * 256 if one is half[0] else 300 * 512 * 511 // 2)
        assert peak < 300e6, peak


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abcdef")), st.sets(st.sampled_from("ghijk"))), max_size=12), st.sampled_from([1, 3, 1000]))
def test_transpose_product_equals_brute_force(rows, products):
    want = defaultdict(int)
    for one, two in rows:
        for p in itertools.product(sorted(one), sorted(two)) if two else itertools.combinations(sorted(one), 2):
            want[p] += 1
    batch = pa.RecordBatch.from_arrays([pa.array([sorted(r[k]) for r in rows], pa.list_(pa.string())) for k in (0, 1)], ["items", "second"])
    got, kept = defaultdict(int), pairs.PRODUCTS
    try:
        pairs.PRODUCTS = products
        for b in pairs.gram(iter([batch])):
            for r in b.to_pylist():
                got[r["tag_a"], r["tag_b"]] += r["n"]
    finally:
        pairs.PRODUCTS = kept
    assert got == want


def test_frequent_share_and_ties(spark):
    rows = [(f"rare{i}", i) for i in range(3000)] + [("#Top", i) for i in range(30)] * 2 + [("edge", i) for i in range(16)] + [(None, 1), ("", 2), ("@", 3)]
    base = distinct(rows)
    at_least = max(-(-len(base) // 200), 10)
    counts = defaultdict(int)
    for a, _ in base:
        counts[a] += 1
    want = {(a, n) for a, n in counts.items() if n >= at_least}
    got = {(r["item"], r["n"]) for r in heavy.frequent_share(make(spark, rows), "hashtag", "tweet_id", capacity=300).collect()}
    assert got == want and ("top", 30) in got and ("edge", 16) in got
    assert heavy.frequent_share(make(spark, []), "hashtag", "tweet_id").count() == 0
    with pytest.raises(ValueError):
        heavy.frequent_share(make(spark, rows), "hashtag", "tweet_id", capacity=100)


@pytest.mark.parametrize("capacity", [20, 4000])
def test_top_k_with_ties(spark, capacity):
    r = random.Random(4)
    rows = [(f"t{int(r.paretovariate(0.7)) % 500}", i) for i in range(4000)]
    counts = defaultdict(int)
    for a, _ in distinct(rows):
        counts[a] += 1
    last = sorted(counts.values(), reverse=True)[9]
    got = {(x["item"], x["n"]): x for x in heavy.top_k(make(spark, rows), "hashtag", "tweet_id", 10, capacity).collect()}
    assert set(got) == {(a, n) for a, n in counts.items() if n >= last}
    assert all(x["lower"] <= x["n"] <= x["upper"] for x in got.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefghij"), max_size=60), max_size=6), st.integers(2, 5))
def test_summary_bounds(batches, capacity):
    data = [pa.RecordBatch.from_pydict({"field": pa.array(["f"] * len(b), pa.string()), "item": pa.array(b, pa.string())}) for b in batches]
    out = [r for b in heavy.summarise(capacity)(iter(data)) for r in b.to_pylist()]
    rows = out or [{"item": None, "n": 0, "err": 0}]
    total, err = rows[0]["n"], rows[0]["err"]
    truth = defaultdict(int)
    for b in batches:
        for x in b:
            truth[x] += 1
    assert total == sum(truth.values()) and len(rows) - 1 <= capacity
    kept = {r["item"]: r["lower"] for r in rows[1:]}
    for x, n in truth.items():
        assert kept.get(x, 0) <= n <= kept.get(x, 0) + err
        assert n * (capacity + 1) <= total or x in kept


def test_fields_are_searched_apart(spark):
    r = random.Random(11)
    rows = [(f, f"t{int(r.paretovariate(0.8)) % 300}" if f == "x" else f"u{r.randrange(40)}", i) for i in range(3000) for f in ("x", "y")]
    counts = defaultdict(int)
    for f, a, _ in set(rows):
        counts[f, a] += 1
    df = spark.createDataFrame([*rows, *rows[:500]], "field string, item string, record long")
    got = {(x["field"], x["item"], x["n"]) for x in heavy.frequent_fields(df, share=40, capacity=300).collect()}
    assert got == {(*k, n) for k, n in counts.items() if n >= max(10, -(-3000 // 40))} and {f for f, *_ in got} == {"x", "y"}
    top = {(x["field"], x["item"], x["n"]) for x in heavy.top_fields(df, 5, capacity=300).collect()}
    last = {f: sorted((n for (g, _), n in counts.items() if g == f), reverse=True)[4] for f in "xy"}
    assert top == {(*k, n) for k, n in counts.items() if n >= last[k[0]]}
    assert heavy.top_fields(df.limit(0)).count() == 0
