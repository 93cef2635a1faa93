"""p1 against brute force."""

import datetime as dt
import random

import pytest

from millrace.functions.names import plain
from millrace.operators.sessions import merge_deliveries, sessionize

T0 = dt.datetime(2012, 1, 1)


def brute(rows, gap):
    by = {}
    for u, t, i in rows:
        if u is not None and t is not None:
            by.setdefault(u, []).append((t, -1 if i is None else i, i))
    out = set()
    for u, e in by.items():
        e.sort(key=lambda x: x[:2])
        no, start = 1, 0
        for k in range(1, len(e) + 1):
            if k == len(e) or e[k][0] - e[k - 1][0] > gap:
                out.add((u, no, e[start][2], e[k - 1][2], e[start][0], e[k - 1][0], k - start))
                no, start = no + 1, k
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "u string, t timestamp_ntz, i long")
    return {(r.user_key, r.session_no, r.first_id, r.last_id, r.start_at, r.end_at, r.n_events) for r in sessionize(df, "u", "t", "i", **kw).collect()}


@pytest.mark.parametrize("bucket", ["10 minutes", "6 hours", "365 days"])
def test_random_rows_any_bucket(spark, bucket):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 5 + ["a", "b", "", None]), r.choice([None, *[T0 + dt.timedelta(minutes=r.randrange(3000))] * 9]), i) for i in range(900)]
    rows += rows[:50] + [("hot", T0, None), ("hot", dt.datetime(1969, 12, 31, 23, 50), 7), ("hot", dt.datetime(1970, 1, 1, 0, 5), 8)]
    assert run(spark, rows, bucket=bucket) == brute(rows, dt.timedelta(minutes=30))


def test_gap_is_exclusive_and_ties_go_by_id(spark):
    m = lambda x: T0 + dt.timedelta(minutes=x)
    assert run(spark, [("a", m(0), 2), ("a", m(0), 1), ("a", m(30), 3), ("a", m(60) + dt.timedelta(microseconds=1), 4)]) == {("a", 1, 1, 3, m(0), m(30), 3), ("a", 2, 4, 4, m(60) + dt.timedelta(microseconds=1), m(60) + dt.timedelta(microseconds=1), 1)}


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame([("a", T0, 1, 5, "x")], "u string, t timestamp_ntz, i long, b int, k string")
    assert sessionize(df, "u", "t", "i").count() == 1


def test_merge_deliveries(spark):
    rows = [(1, "@Ann", T0), (1, None, T0 - dt.timedelta(1)), (2, " ann ", None), (2, None, T0), (3, None, T0), (4, "x", None), (None, "x", T0), (5, "##", T0)]
    df = spark.createDataFrame(rows, "id long, author string, at timestamp_ntz")
    got = {tuple(r) for r in merge_deliveries(df, "id", plain("author"), "at").collect()}
    assert got == {(1, "ann", T0 - dt.timedelta(1)), (2, "ann", T0), (5, "", T0)}
