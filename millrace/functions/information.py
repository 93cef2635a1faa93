"""Information functions of the dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numeric import _c


def database() -> Column:
    """DATABASE(): the session's current schema."""
    return F.current_database()


def charset(x) -> Column:
    """CHARSET(x): utf8 of a text, binary of anything else (by the type, so of NULL too)."""
    return F.when(F.typeof(_c(x)) == "string", "utf8").otherwise("binary")


def collation(x) -> Column:
    """COLLATION(x): the collation that Spark gives the text, in its last part."""
    return F.element_at(F.split(F.collation(_c(x)), r"\."), -1)
