"""Conditional functions and lenient casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numeric import _c, unsigned


def if_(cond, a, b) -> Column:
    """IF: a where the condition holds, b where it is false or NULL."""
    return F.when(F.coalesce(cond, F.lit(False)), a).otherwise(b)


def as_int(pred: Column) -> Column:
    """A predicate as 0, 1 or NULL."""
    return pred.cast("int")


def truth(x) -> Column:
    """A number as a predicate: non-zero is true."""
    return _c(x) != 0


def xor(a: Column, b: Column) -> Column:
    """Three-valued exclusive or."""
    return a != b


def lenient_number(s) -> Column:
    """Longest numeric prefix of a text as DOUBLE, 0 where there is none; NULL stays NULL."""
    s = _c(s)
    prefix = F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(s.isNotNull(), F.coalesce(prefix.try_cast("double"), F.lit(0.0)))


def to_signed(s) -> Column:
    """CAST(text AS SIGNED): integer prefix, saturated at the limits of BIGINT."""
    s = _c(s)
    digits = F.regexp_extract(s, r"^\s*([+-]?\d+)", 1)
    d = digits.try_cast("decimal(38,0)")
    top, low = F.lit(9223372036854775807), F.lit(-9223372036854775808)
    return F.when(s.isNull(), None).when(d.isNull(), F.lit(0)).when(d > top, top).when(d < low, low).otherwise(d.cast("long"))


def to_unsigned(x) -> Column:
    """CONVERT(x, UNSIGNED) of an integer: negative values wrap at 2^64."""
    return unsigned(x)
