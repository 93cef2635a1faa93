"""Numeric functions of the dialect, as Column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^64, the modulus of unsigned 64-bit arithmetic.
TWO64 = "18446744073709551616"


def _c(x: Column | str | int | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def divide(a, b) -> Column:
    """a / b as DOUBLE; division by zero gives NULL."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def divide_exact(a, b, scale: int = 4) -> Column:
    """a / b of integers or decimals, exact, with ``scale`` more digits; by zero NULL."""
    d = F.nullif(_c(b).cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))
    return F.round(_c(a).cast("decimal(20,4)") / d, scale).cast(f"decimal(24,{scale})")


def int_div(a, b) -> Column:
    """a DIV b: truncated towards zero, decimal operands allowed; by zero NULL."""
    q = _c(a).cast("decimal(20,6)") / F.nullif(_c(b).cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def modulo(a, b) -> Column:
    """a MOD b with the sign of a; by zero NULL."""
    return F.try_mod(_c(a), _c(b))


def truncate_exact(x, d: int) -> Column:
    """An integer or DECIMAL cut to d digits towards zero (d may be negative), in decimal arithmetic."""
    x = _c(x)
    return F.when(x < 0, F.ceil(x, F.lit(d))).otherwise(F.floor(x, F.lit(d)))


def truncate(x, d: int) -> Column:
    """A DOUBLE cut to d digits towards zero (d may be negative); ``truncate_exact`` is for DECIMAL."""
    p = F.lit(10.0**d)
    x = _c(x).cast("double")
    return F.signum(x) * F.floor(F.abs(x) * p) / p


def unsigned(x) -> Column:
    """The 64 bits of a BIGINT read as unsigned, DECIMAL(20,0)."""
    x = _c(x).cast("long")
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, (d + F.lit(TWO64).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(d)


def shift_left(x, n) -> Column:
    """x << n over 64 bits, unsigned; n >= 64 gives 0."""
    x, n = _c(x).cast("long"), _c(n).cast("int")
    return unsigned(F.when(n >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", x, n)))


def shift_right(x, n) -> Column:
    """x >> n over 64 bits, unsigned; n >= 64 gives 0."""
    x, n = _c(x).cast("long"), _c(n).cast("int")
    return unsigned(F.when(n >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", x, n)))


def bit_not(x) -> Column:
    """~x over 64 bits, unsigned."""
    return unsigned(F.bitwise_not(_c(x).cast("long")))


def greatest_strict(*xs) -> Column:
    """GREATEST that is NULL if any argument is."""
    xs = [_c(x) for x in xs]
    some = xs[0].isNull()
    for x in xs[1:]:
        some = some | x.isNull()
    return F.when(~some, F.greatest(*xs))


def zerofill(x, width: int) -> Column:
    """Display form of a number, padded with zeros; wider numbers stay whole."""
    s = _c(x).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)
