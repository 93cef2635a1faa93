"""Document collections: rows with a JSON column, found and changed by path."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.documents import json_set

# Comparisons of the query builder.
_COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


def member(doc: str, path: str, kind: str = "string") -> Column:
    """A member of the document, typed."""
    return F.get_json_object(F.col(doc), path).try_cast(kind)


def find(df: DataFrame, where: Column | None = None, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """Find: filter, then order, then limit."""
    df = df.where(where) if where is not None else df
    df = df.orderBy(*order) if order else df
    return df.limit(limit) if limit is not None else df


def modify(df: DataFrame, doc: str, path: str, value: Column, where: Column) -> DataFrame:
    """Sets a member in the documents that fulfil the condition."""
    return df.withColumn(doc, F.when(F.coalesce(where, F.lit(False)), json_set(doc, path, value)).otherwise(F.col(doc)))


@dataclass(frozen=True)
class Query:
    """A query over fields with named parameters, built step by step and run with their values.

    >>> Query(orders).where("o_totalprice", "gt", "least").order("o_orderkey").limit(5).run(least=100)

    Each step gives a new query. Conditions are joined by AND; ``kind`` is one of eq, ne, lt, le, gt,
    ge, between (two parameters), in, isnull and notnull (none).
    """

    table: DataFrame
    terms: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    orders: tuple[Column, ...] = ()
    first: int | None = None

    def where(self, field: str, kind: str, *params: str) -> Query:
        need = {"between": 2, "isnull": 0, "notnull": 0}.get(kind, 1)
        if kind not in (*_COMPARE, "between", "in", "isnull", "notnull") or len(params) != need:
            raise ValueError(f"{kind} with {len(params)} parameters")
        return replace(self, terms=(*self.terms, (field, kind, params)))

    def order(self, field: str, descending: bool = False) -> Query:
        c = F.col(f"`{field}`")
        return replace(self, orders=(*self.orders, c.desc() if descending else c.asc()))

    def limit(self, n: int) -> Query:
        return replace(self, first=n)

    def run(self, **values) -> DataFrame:
        """The rows; a parameter without a value is an error, as is a value without a parameter."""
        named = {p for *_, params in self.terms for p in params}
        if named != set(values):
            raise ValueError(f"parameters: {sorted(named)}")
        df = self.table
        for field, kind, params in self.terms:
            c, v = F.col(f"`{field}`"), [values[p] for p in params]
            if kind in _COMPARE:
                df = df.where(_COMPARE[kind](c, F.lit(v[0])))
            elif kind == "between":
                df = df.where(c.between(*v))
            elif kind == "in":
                df = df.where(c.isin(*v[0]))
            else:
                df = df.where(c.isNull() if kind == "isnull" else c.isNotNull())
        return find(df, None, self.orders, self.first)
