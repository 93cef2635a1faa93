"""Writes as DataFrame transformations: each takes the table and returns the table after the write.

Tables are values here (a DataFrame in, a DataFrame out); write the result with ``write.parquet``
or as a table. Keys compare null-safe: a null key is a key like any other. None of the functions
collects rows. Where rows of the batch repeat a key, each docstring says which one counts;
``seq`` names a column that orders the batch, rows with the same ``seq`` are ordered by their values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW = "__row"
#: Rows of one key that are folded in order by a function.
FOLD_ROWS = 100_000


class DuplicateKey(ValueError):
    """A key comes more than once where it must be unique."""


class CheckFailed(ValueError):
    """A row lies outside the condition of a view or constraint."""


class TooManyRepeats(ValueError):
    """A key has more rows in a batch than can be folded in order."""


@dataclass
class Plus:
    """Assignment ``c = c + value``; ``value`` is over ``new.c``. Sums of parts are combined, so a key may have any number of rows."""

    value: Column


def _same(a: DataFrame, b: DataFrame, key: Sequence[str], x: str, y: str) -> Column:
    return reduce(lambda p, q: p & q, (F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in key))


def _pair(a: DataFrame, b: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    return a.alias("a").join(b.alias("b"), _same(a, b, key, "a", "b"), how)


def _order(batch: DataFrame, seq: str) -> Column:
    """Total order of a batch: ``seq``, then the values (columns without an order aside)."""
    return F.struct(F.col(seq), *[F.col(f"`{f.name}`") for f in batch.schema if f.name != seq and not isinstance(f.dataType, (T.MapType, T.VariantType))])


def _row(batch: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in batch.columns])


def last_of(batch: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The row with the largest ``seq`` of each key; an aggregate, so that a hot key is combined before the shuffle."""
    return batch.groupBy(*key).agg(F.max_by(_row(batch), _order(batch, seq)).alias(_ROW)).select(f"{_ROW}.*")


def first_of(batch: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The row with the smallest ``seq`` of each key (a null ``seq`` is the smallest)."""
    return batch.groupBy(*key).agg(F.min_by(_row(batch), _order(batch, seq)).alias(_ROW)).select(f"{_ROW}.*")


def insert(table: DataFrame, batch: DataFrame) -> DataFrame:
    """INSERT: rows appended by position, cast to the table's types."""
    if len(batch.columns) != len(table.columns):
        raise ValueError("column count does not match")
    return table.unionAll(batch.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(batch.columns, table.schema.fields, strict=True)]))


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table itself, or DuplicateKey if a key comes more than once (rows with a null in it are free)."""
    known = df.where(reduce(lambda p, q: p & q, (F.col(k).isNotNull() for k in key)))
    if known.groupBy(*key).count().where("count > 1").limit(1).count():
        raise DuplicateKey(", ".join(key))
    return df


def require_check(df: DataFrame, condition: Column) -> DataFrame:
    """The rows themselves, or CheckFailed if the condition is false for one (NULL passes)."""
    if df.where(~F.coalesce(condition, F.lit(True))).limit(1).count():
        raise CheckFailed(str(condition))
    return df


def insert_through_view(table: DataFrame, batch: DataFrame, condition: Column) -> DataFrame:
    """INSERT into a view WITH CHECK OPTION: every row must fulfil the view's condition."""
    if batch.where(~F.coalesce(condition, F.lit(False))).limit(1).count():
        raise CheckFailed(str(condition))
    return insert(table, batch)


def insert_ignore(table: DataFrame, batch: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """INSERT IGNORE: rows whose key exists are skipped; of repeated keys in the batch the first counts."""
    new = _pair(first_of(batch, key, seq).drop(seq), table.select(*key), key, "left_anti")
    return insert(table, new.select(*table.columns))


def replace_into(table: DataFrame, batch: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """REPLACE INTO: old rows with a key of the batch go; of repeated keys in the batch the last counts."""
    new = last_of(batch, key, seq).drop(seq)
    return insert(_pair(table, new.select(*key), key, "left_anti").select(*table.columns), new.select(*table.columns))


def upsert(table: DataFrame, batch: DataFrame, key: Sequence[str], seq: str, set_: dict[str, Column | Plus | Callable[[Column, Column], Column]]) -> DataFrame:
    """INSERT ... ON DUPLICATE KEY UPDATE: the rows of the batch are taken one after another, in the order of ``seq``.

    A row whose key exists by then updates it, the first row of a new key is inserted, so later rows
    of that key update it. ``set_`` gives the new values of columns: a Column over ``new.c`` (the incoming
    row), ``Plus``, or a function of (old, new), rows whose columns are ``old["c"]``; assignments run left
    to right and see earlier ones. Columns and ``Plus`` are aggregated (sums of DOUBLE up to rounding);
    a function is folded row by row, which needs the rows of a key together: TooManyRepeats is raised where
    a key has more than FOLD_ROWS of them. Functions can't be mixed with the other two.
    """
    for c, v in set_.items():
        if isinstance(v, Column) and "old." in str(v):
            raise ValueError(f"{c}: give a function of (old, new), or Plus")
    cols = table.columns
    old = table.withColumn("__is", F.lit(True)).alias("old")
    own = {c: F.col(f"old.{c}") for c in cols}
    if any(not isinstance(v, (Column, Plus)) for v in set_.values()):
        if any(isinstance(v, (Column, Plus)) for v in set_.values()):
            raise ValueError("beside a function, give every assignment as a function of (old, new)")
        if batch.groupBy(*key).count().where(F.col("count") > FOLD_ROWS).limit(1).count():
            raise TooManyRepeats(f"more than {FOLD_ROWS} rows of a key")
        kinds = [table.schema[c].dataType for c in cols]
        struct = lambda values: F.struct(*[v.cast(t).alias(c) for c, t, v in zip(cols, kinds, values, strict=True)])
        ordered = F.struct(_order(batch, seq).alias("o"), struct([F.col(f"`{c}`") for c in cols]).alias("r"))
        lists = batch.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(ordered)), lambda x: x["r"]).alias("__rows")).alias("new")

        def step(acc: Column, row: Column) -> Column:
            now = {c: acc[c] for c in cols}
            for c, v in set_.items():
                seen = struct(list(now.values()))
                now[c] = v(seen, row)
            return struct(list(now.values()))

        both = old.join(lists, _same(table, batch, key, "old", "new"), "full_outer")
        known, rows = F.col("old.__is").isNotNull(), F.coalesce(F.col("new.__rows"), F.array().cast(T.ArrayType(T.StructType([T.StructField(c, t) for c, t in zip(cols, kinds, strict=True)]))))
        start = F.when(known, struct(list(own.values()))).otherwise(F.try_element_at(rows, F.lit(1)))
        rest = F.when(known, rows).otherwise(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))))
        return both.select(F.aggregate(rest, start, step).alias(_ROW)).select(f"{_ROW}.*")
    rows = batch.alias("new")
    order, plus = _order(batch, seq), {c: v.value for c, v in set_.items() if isinstance(v, Plus)}
    sums = [x for n, v in enumerate(plus.values()) for x in (F.sum(v).alias(f"__s{n}"), F.min_by(v, order).alias(f"__f{n}"), F.count_if(v.isNull()).alias(f"__n{n}"))]
    merged = rows.groupBy(*key).agg(F.min_by(_row(batch), order).alias("__first"), F.max_by(_row(batch), order).alias("new"), F.count(F.lit(1)).alias("__c"), *sums)
    merged = merged.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(key)], *[c for c in merged.columns if c not in key])
    both = old.join(merged, reduce(lambda p, q: p & q, (F.col(f"old.{k}").eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(key))), "full_outer")
    is_, in_, many = F.col("old.__is").isNotNull(), F.col("__c").isNotNull(), F.col("__c") > 1

    def value(c: str) -> Column:
        first = F.col(f"__first.{c}")
        if c not in set_:
            return F.when(is_, own[c]).otherwise(first)
        if c in plus:
            n = list(plus).index(c)
            s, f, nulls = (F.col(f"__{x}{n}") for x in "sfn")
            after = F.when(nulls == 0, own[c] + s)  # a null anywhere makes the sum null
            later = F.when(nulls - f.isNull().cast("int") == 0, first + F.coalesce(s - F.coalesce(f, F.lit(0)), F.lit(0)))
            return F.when(is_ & in_, after).when(is_, own[c]).when(many, later).otherwise(first)
        return F.when(in_ & (is_ | many), set_[c]).when(is_, own[c]).otherwise(first)

    return both.select(*[value(c).cast(table.schema[c].dataType).alias(c) for c in cols])


def update(table: DataFrame, set_: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE: assignments run left to right, later ones see earlier ones; a NULL condition changes nothing."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    df = table.withColumn("__hit", hit)
    for c, value in set_.items():
        df = df.withColumn(c, F.when(F.col("__hit"), value).otherwise(F.col(c)).cast(table.schema[c].dataType))
    return df.drop("__hit")


def update_ignore(table: DataFrame, key: str, value: Column) -> DataFrame:
    """UPDATE IGNORE of a key: rows whose new key is some row's old key, or another row's new key with
    a smaller old key, stay as they are."""
    df = table.withColumn("__new", value.cast(table.schema[key].dataType))
    first = df.groupBy("__new").agg(F.min(key).alias("__least"))
    taken = table.select(F.col(key).alias("__taken")).distinct()
    df = df.join(first, "__new", "left").join(taken, F.col("__new") == F.col("__taken"), "left")
    free = F.col("__taken").isNull() & (F.col(key) == F.col("__least"))
    return df.withColumn(key, F.when(free, F.col("__new")).otherwise(F.col(key))).select(*table.columns)


def _first_n(table: DataFrame, where: Column, order: Sequence[Column], n: int, key: Sequence[str]) -> DataFrame:
    """Keys of the first n rows; a top-n, so that no window over the whole table is needed."""
    return table.where(where).orderBy(*order).limit(n).select(*key)


def update_limit(table: DataFrame, set_: dict[str, Column], where: Column, order: Sequence[Column], n: int, key: Sequence[str]) -> DataFrame:
    """UPDATE ... ORDER BY ... LIMIT n; ``key`` is unique, ``order`` total."""
    hits = _first_n(table, where, order, n, key).withColumn("__hit", F.lit(True))
    df = _pair(table, hits, key, "left").select("a.*", F.coalesce(F.col("b.__hit"), F.lit(False)).alias("__hit"))
    for c, value in set_.items():
        df = df.withColumn(c, F.when(F.col("__hit"), value).otherwise(F.col(c)).cast(table.schema[c].dataType))
    return df.drop("__hit")


def delete(table: DataFrame, where: Column) -> DataFrame:
    """DELETE: rows whose condition is true go; NULL keeps a row."""
    return table.where(~F.coalesce(where, F.lit(False)))


def delete_limit(table: DataFrame, where: Column, order: Sequence[Column], n: int, key: Sequence[str]) -> DataFrame:
    """DELETE ... ORDER BY ... LIMIT n; ``key`` is unique, ``order`` total."""
    return _pair(table, _first_n(table, where, order, n, key), key, "left_anti").select(*table.columns)


def update_join(table: DataFrame, other: DataFrame, on: Sequence[str], set_: dict[str, Column], order: Sequence[Column] = ()) -> DataFrame:
    """UPDATE t JOIN o: columns over ``t.c`` and ``o.c``; rows without a partner (or with a null key) stay.

    A row is updated once: of several partners the first in ``order`` (columns of ``other``) counts,
    ties go by their values.
    """
    cond = reduce(lambda p, q: p & q, (F.col(f"t.{k}") == F.col(f"o.{k}") for k in on))
    values = [F.col(f"`{f.name}`") for f in other.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    one = other.groupBy(*on).agg(F.min_by(_row(other), F.struct(*[c.alias(f"o{n}") for n, c in enumerate([*order, *values])])).alias(_ROW)).select(f"{_ROW}.*")
    o = one.withColumn("__in", F.lit(True)).alias("o")
    hit = F.col("o.__in").isNotNull()
    return table.alias("t").join(o, cond, "left").select(*[F.when(hit, set_[c]).otherwise(F.col(f"t.{c}")).cast(table.schema[c].dataType).alias(c) if c in set_ else F.col(f"t.{c}") for c in table.columns])


def delete_join(table: DataFrame, other: DataFrame, on: Sequence[str], matching: bool = True) -> DataFrame:
    """DELETE t FROM t JOIN o: rows with a partner go (``matching``), or rows without one.

    Null keys have no partner.
    """
    return table.join(other.select(*on).distinct(), list(on), "left_anti" if matching else "left_semi").select(*table.columns)


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


def create_like(table: DataFrame) -> DataFrame:
    return table.sparkSession.createDataFrame([], table.schema)


def auto_increment(table: DataFrame, batch: DataFrame, column: str, order: Sequence[Column]) -> DataFrame:
    """INSERT with generated ids: they go on from the largest id of the table (0 if it has none)."""
    from millrace.operators.numbering import number_rows

    top = table.agg(F.coalesce(F.max(column), F.lit(0)).alias("m")).first()["m"]
    rows = number_rows(batch, order, "__n").withColumn(column, (F.lit(top) + F.col("__n")).cast(table.schema[column].dataType)).drop("__n")
    return table.unionByName(rows.select(*table.columns))


def add_column(table: DataFrame, name: str, value: Column) -> DataFrame:
    return table.withColumn(name, value)


def change_column(table: DataFrame, old: str, new: str, dtype: str) -> DataFrame:
    """CHANGE COLUMN: renamed and cast, in place."""
    return table.select(*[F.col(c).cast(dtype).alias(new) if c == old else F.col(c) for c in table.columns])


def drop_column(table: DataFrame, name: str) -> DataFrame:
    """DROP COLUMN; an unknown name is an error."""
    if name not in table.columns:
        raise ValueError(f"no column {name}")
    return table.drop(name)


def modify_column(table: DataFrame, name: str, dtype: str) -> DataFrame:
    """MODIFY COLUMN: another type, in place; values that do not fit it are an error."""
    return table.select(*[F.col(c).cast(dtype).alias(c) if c == name else F.col(c) for c in table.columns])
