"""Joins, set operations and limits of the dialect that Spark has under another form."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a side that may be broadcast; a side is only broadcast after its size was checked.
SMALL_ROWS = 100_000
#: Column of a counted table: the number of rows that a row stands for.
TIMES = "__times"


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def not_in(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """``key NOT IN (SELECT right_key ...)``: a null in the list gives no row, an empty list all rows.

    The nulls are handled by two scalar subqueries of the right side, which stop at the first row
    that they find (a file without nulls is not read for the one), so that the join itself stays an
    equi anti join, which is shuffled and spilled like any other.
    """
    some = lambda df: df.limit(1).agg(F.count(F.lit(1))).scalar() > 0
    keys = right.select(F.col(right_key).alias("__k"))
    rest = left.join(keys, F.col(key) == F.col("__k"), "left_anti")
    return rest.where(~some(keys) | (F.col(key).isNotNull() & ~some(keys.where(F.col("__k").isNull()))))


def not_in_range(left: DataFrame, key: str, bound: str, right: DataFrame, right_key: str, right_bound: str, op: str) -> DataFrame:
    """``key NOT IN (SELECT right_key FROM right WHERE right_bound op bound)``, correlated by a range.

    ``op``: <, <=, > or >=. The list of a row holds the keys of the right rows within its bound. An
    empty list keeps the row, whatever its key; else a null key, or a null in the list, drops it. The
    right side is reduced to the extreme bound of each key (and of all keys), since one row within
    the bound is enough; so this is an equi join with at most one partner for each row.
    """
    if op not in ("<", "<=", ">", ">="):
        raise ValueError(op)
    extreme = F.min if op[0] == "<" else F.max
    within = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    keys = right.groupBy(F.col(right_key).alias("__k")).agg(extreme(right_bound).alias("__b"))
    out = left.join(keys.where(F.col("__k").isNotNull()), F.col(key) == F.col("__k"), "left")
    inside = lambda b: F.coalesce(within(b, F.col(bound)), F.lit(False))
    any_ = keys.agg(extreme("__b")).scalar()
    null = keys.where(F.col("__k").isNull()).agg(extreme("__b")).scalar()
    listed = F.when(~inside(any_), False).when(F.col(key).isNull() | inside(null), True).otherwise(inside(F.col("__b")))
    return out.where(~listed).drop("__k", "__b")


def hash_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Hash join whose table is built from the side that the plan's statistics say is smaller."""
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return a.join(b.hint("shuffle_hash"), on, how) if size(b) <= size(a) else a.hint("shuffle_hash").join(b, on, how)


def straight_join(first: DataFrame, *steps: tuple[DataFrame, Column] | tuple[DataFrame, Column, str]) -> DataFrame:
    """Joins in the written order, left to right; each step is (table, condition[, type]).

    The planner keeps the written order of outer joins, and of inner joins while cost-based
    reordering is off; with it on, the order can't be promised, and this raises.
    """
    if first.sparkSession.conf.get("spark.sql.cbo.joinReorder.enabled", "false") == "true":
        raise ValueError("spark.sql.cbo.joinReorder.enabled is on")
    for df, on, *how in steps:
        first = first.join(df, on, how[0] if how else "inner")
    return first


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all common column names; without one, an error instead of a cartesian product."""
    common = [c for c in a.columns if c in b.columns]
    if not common:
        raise ValueError("no common column")
    return a.join(b, common, how)


def counted(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct rows of the columns (nulls are equal) with the number of their rows in ``TIMES``; a counted table's add up."""
    return df.groupBy(*columns).agg((F.sum(TIMES) if TIMES in df.columns else F.count(F.lit(1))).alias(TIMES))


def counted_join(a: DataFrame, b: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Inner, left, right or full join of counted tables (or plain ones): the rows of the plain join, counted in ``TIMES``.

    A row stands for as many rows as the product of those that its sides stand for, the missing side of
    an outer join for one. Keys that repeat on both sides are multiplied here, not in rows.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(how)
    times = lambda df, c: F.coalesce(F.col(c), F.lit(1)) if TIMES in df.columns else F.lit(1)
    both = (times(a, TIMES) * times(b, "__others")).cast("long")
    return a.join(b.withColumnRenamed(TIMES, "__others"), on, how).withColumn(TIMES, both).drop("__others")


def spread_join(big: DataFrame, other: DataFrame, key: str, how: str = "inner", hot_share: int = 1000, salts: int = 32) -> DataFrame:
    """Equi join of a skewed table: rows of keys above 1/hot_share of it are salted.

    The hot keys are at most ``hot_share`` (a proven bound, so their list is broadcast); their
    partner rows are repeated once for each salt, all other rows are joined plainly. A salt comes
    from the row and its partition, so that a task that runs again gives the same one. All types of
    join give the rows of the plain join: in right and full joins the partner rows without a match
    are added by an anti join on the key, once each. Columns are those of ``big.join(other, key, how)``.
    """
    kind = how.lower().replace("_", "").removesuffix("outer")
    total = big.count()
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.where(F.col("__n") * hot_share > total).select(F.col(key).alias("__hot"))
    marked = big.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]) + F.spark_partition_id(), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("__hot")
    o = other.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    o = o.withColumn("__salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    joined = marked.join(o, [key, "__salt"], {"right": "inner", "full": "left"}.get(kind, how)).drop("__salt")
    if kind not in ("right", "full"):
        return joined
    own, theirs = [f for f in big.schema if f.name != key], [c for c in other.columns if c != key]
    alone = other.join(counts.select(key), key, "left_anti")
    return joined.union(alone.select(key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in own], *theirs))


def union_types(a: DataFrame, b: DataFrame) -> DataFrame:
    """UNION ALL with the dialect's type unification, by position.

    Numbers widen (decimals to the larger scale, at most 38 digits), a number with text and a
    datetime with text give text, a datetime with a number is an error.
    """
    if len(a.columns) != len(b.columns):
        raise ValueError("the sides have different numbers of columns")
    casts = []
    for x, y in zip(a.schema.fields, b.schema.fields, strict=True):
        p, q = x.dataType, y.dataType
        time = [isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in (p, q)]
        text = [isinstance(t, T.StringType) for t in (p, q)]
        number = [isinstance(t, T.NumericType) for t in (p, q)]
        if any(text) and p != q:
            casts.append("string")
        elif isinstance(p, T.DecimalType) and isinstance(q, T.DecimalType):
            s = max(p.scale, q.scale)
            casts.append(f"decimal({min(38, max(p.precision - p.scale, q.precision - q.scale) + s)},{s})")
        elif time[0] and number[1] or number[0] and time[1]:
            raise ValueError(f"{p.simpleString()} and {q.simpleString()} do not unify")
        else:
            casts.append(None)
    side = lambda df: df.select(*[F.col(f"`{c}`").cast(t).alias(n) if t else F.col(f"`{c}`").alias(n) for c, t, n in zip(df.columns, casts, a.columns, strict=True)])
    return side(a).unionAll(side(b))


def limit_offset(df: DataFrame, order: Sequence[Column], n: int, offset: int = 0) -> DataFrame:
    """ORDER BY ... LIMIT n OFFSET k as a top-k."""
    return df.orderBy(*order).offset(offset).limit(n)


def found_rows(df: DataFrame, order: Sequence[Column], n: int) -> tuple[DataFrame, int]:
    """The first n rows and the number of all rows."""
    return df.orderBy(*order).limit(n), df.count()


def match_against(df: DataFrame, column: str, query: str, ranked: bool = False) -> DataFrame:
    """Fulltext in boolean mode: ``+word`` must occur, ``-word`` must not, plain words raise ``relevance``.

    ``word*`` stands for every word that begins so, ``"some words"`` for a phrase; both take + and -.
    Words are letters and digits, compared in lower case. Rows without a match are left out; a
    null text matches nothing. Relevance is the number of occurrences of the wanted terms; with
    ``ranked`` the rows come in falling relevance.
    """
    text = F.concat(F.lit(" "), F.lower(F.regexp_replace(F.col(column), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    terms = [(sign, term) for sign, quoted, word in re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', query.lower()) if (term := quoted or word)]

    def pattern(term: str) -> str:
        words = re.findall(r"\w+", term.replace("_", " "))
        return "(?<= )" + " ".join(words) + ("" if term.endswith("*") else "(?= )")

    has = lambda t: text.rlike(pattern(t))
    must, never, may = ([t for s, t in terms if s == sign] for sign in ("+", "-", ""))
    ok = F.col(column).isNotNull()
    for t in must:
        ok = ok & has(t)
    for t in never:
        ok = ok & ~has(t)
    if may and not must:
        ok = ok & reduce(lambda p, q: p | q, map(has, may))
    score = F.lit(0)
    for t in must + may:
        score = score + F.regexp_count(text, F.lit(pattern(t)))
    out = df.where(F.coalesce(ok, F.lit(False))).withColumn("relevance", score)
    return out.orderBy(F.desc("relevance")) if ranked else out


def group_concat_limited(df: DataFrame, keys: Sequence[str], value: str, name: str, sep: str = ",", order: Sequence[Column] = (), max_len: int = 1024) -> DataFrame:
    """GROUP_CONCAT cut to ``max_len`` characters, for groups of any size.

    A result of ``max_len`` characters has at most so many values (``sep`` must not be empty), so only
    the first ones of each group in ``order`` (else their own) are kept; the plan does that before the
    shuffle. Nulls are left out; a group of nulls gives NULL; ties in ``order`` go by value.
    """
    if not sep:
        raise ValueError("an empty separator has no bound on the number of values")
    v = F.col(value)
    ranked = df.select(*keys, v.cast("string").alias("__v"), F.row_number().over(Window.partitionBy(*keys).orderBy(v.isNull(), *(order or ()), v)).alias("__r"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("__r", "__v")))), lambda r: r["__v"]), sep)
    return ranked.where(F.col("__r") <= max_len).groupBy(*keys).agg(F.when(F.count("__v") > 0, F.left(text, F.lit(max_len))).alias(name))
