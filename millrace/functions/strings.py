"""String functions of the dialect."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numeric import _c


def mid(s, pos, length=None) -> Column:
    """MID / SUBSTR / SUBSTRING: position 0 or before the start gives ''; negative counts from the end."""
    s, pos = _c(s).cast("string"), _c(pos)
    n = F.char_length(s)
    size = _c(length) if length is not None else n
    return F.when(s.isNull() | pos.isNull() | size.isNull(), None).when((pos == 0) | (F.abs(pos) > n) | (size <= 0), "").otherwise(F.substring(s, pos, size))


def left(s, n) -> Column:
    """First n characters; n <= 0 gives ''."""
    return F.left(_c(s).cast("string"), _c(n))


def right(s, n) -> Column:
    """Last n characters; n <= 0 gives ''."""
    return F.right(_c(s).cast("string"), _c(n))


def strcmp(a, b) -> Column:
    """-1, 0 or 1 by code point order; NULL if either is NULL."""
    a, b = _c(a), _c(b)
    return F.when(a.isNull() | b.isNull(), None).when(a < b, -1).when(a > b, 1).otherwise(0)


def insert(s, pos, length, new) -> Column:
    """INSERT(s, pos, len, new): s unchanged if pos lies outside; len beyond the end takes the rest."""
    s, pos, length, new = _c(s), _c(pos), _c(length), _c(new)
    n = F.char_length(s)
    keep = F.when((length < 0) | (pos + length > n), F.lit("")).otherwise(F.substring(s, pos + length, n))
    return F.when((pos < 1) | (pos > n), s).otherwise(F.concat(F.substring(s, F.lit(1), pos - 1), new, keep))


def ord_(s) -> Column:
    """Code of the first character: its UTF-8 bytes as one number; '' gives 0."""
    first = F.substring(_c(s), 1, 1)
    return F.when(_c(s) == "", 0).otherwise(F.conv(F.hex(F.encode(first, "UTF-8")), 16, 10).cast("long"))


def weight_string(s) -> Column:
    """Sort key of the case-insensitive collation, in hex."""
    return F.hex(F.encode(F.upper(_c(s)), "UTF-8"))


def equal_char(a, b) -> Column:
    """Equality of CHAR values: trailing blanks do not count."""
    return F.rtrim(_c(a)) == F.rtrim(_c(b))


def field(x, *options) -> Column:
    """1-based place of x among the options, 0 if absent or NULL."""
    out = F.lit(0)
    for i in range(len(options), 0, -1):
        out = F.when(_c(x) == _c(options[i - 1]) if isinstance(options[i - 1], Column) else _c(x) == F.lit(options[i - 1]), i).otherwise(out)
    return out


def elt(n, *options) -> Column:
    """The n-th option, NULL outside."""
    return F.try_element_at(F.array(*[F.lit(o) for o in options]), F.when((_c(n) >= 1) & (_c(n) <= len(options)), _c(n)))


# The code of each letter from A to Z.
_SOUNDEX = "01230120022455012623010202"


def soundex(s) -> Column:
    """SOUNDEX of any length: vowels fall away first, then runs of one code; letters A to Z only."""
    letters = F.regexp_replace(F.upper(_c(s)), "[^A-Z]", "")
    codes = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _SOUNDEX)
    rest = F.regexp_replace(F.concat(F.left(codes, F.lit(1)), F.replace(F.substring(codes, 2, 2**31 - 1), F.lit("0"), F.lit(""))), r"(.)\1+", "$1")
    out = F.concat(F.left(letters, F.lit(1)), F.substring(rest, 2, 2**31 - 1))
    return F.when(letters == "", "").when(F.length(out) < 4, F.rpad(out, 4, "0")).otherwise(out)


def gbk_bytes(s) -> Column:
    """Bytes of a string in GBK (Spark's encode does not know it); unmappable characters become '?'."""
    @F.pandas_udf("binary")
    def enc(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else x.encode("gbk", "replace"))

    return enc(_c(s))
