"""Address functions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numeric import _c

_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$"


def is_ipv4(s) -> Column:
    return _c(s).rlike(_V4).cast("int")


def inet_aton(s) -> Column:
    """Dotted address to number; NULL if it is none."""
    p = F.split(_c(s), r"\.")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("long")
    return F.when(_c(s).rlike(_V4), n(1) * 16777216 + n(2) * 65536 + n(3) * 256 + n(4))


def inet_ntoa(n) -> Column:
    """Number to dotted address; NULL outside 32 bits."""
    n = _c(n).cast("long")
    part = lambda k: F.call_function("shiftright", n, F.lit(k)).bitwiseAND(F.lit(255).cast("long")).cast("string")
    return F.when((n >= 0) & (n <= 4294967295), F.concat_ws(".", part(24), part(16), part(8), part(0)))


def _address(s: str | None):
    try:
        return ipaddress.ip_address(s) if s is not None else None
    except ValueError:
        return None


def is_ipv6(s) -> Column:
    @F.pandas_udf("int")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else int(getattr(_address(x), "version", 0) == 6) for x in v], dtype="Int32")

    return run(_c(s))


def inet6_aton(s) -> Column:
    """Address (either version) to its bytes; NULL if it is none."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if (a := _address(x)) is None else a.packed for x in v], dtype=object)

    return run(_c(s))


def inet6_ntoa(b) -> Column:
    """Bytes (4 or 16) to the address; NULL for other lengths."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([str(ipaddress.ip_address(bytes(x))) if x is not None and len(x) in (4, 16) else None for x in v], dtype=object)

    return run(_c(b))
