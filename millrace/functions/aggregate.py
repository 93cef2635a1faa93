"""Aggregate functions of the dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numeric import _c


def group_concat(x, sep: str = ",", *, order=None, descending: bool = False, distinct: bool = False) -> Column:
    """GROUP_CONCAT: values joined in their own order or that of ``order``; nulls are left out.

    Numbers are ordered as numbers. A group without a value gives NULL.
    """
    x = _c(x)
    if order is None:
        held = F.collect_set(x) if distinct else F.collect_list(x)
        sorted_ = F.sort_array(held, asc=not descending)
        text = F.array_join(F.transform(sorted_, lambda v: v.cast("string")), sep)
        return F.when(F.size(held) > 0, text)
    row = F.when(x.isNotNull(), F.struct(_c(order).alias("o"), x.cast("string").alias("v")))
    held = F.collect_set(row) if distinct else F.collect_list(row)
    return F.when(F.size(held) > 0, F.array_join(F.transform(F.sort_array(held, asc=not descending), lambda r: r["v"]), sep))


def avg_cost(price, quantity) -> Column:
    """Average of prices weighted by quantities."""
    return F.try_divide(F.sum(_c(price) * _c(quantity)), F.sum(_c(quantity)))


def median_(x) -> Column:
    return F.median(_c(x))
