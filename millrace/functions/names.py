"""Normal forms of names and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(c: Column | str) -> Column:
    """Plain form: blanks around removed, leading @ or # signs removed, blanks again, lower case.

    Null stays null; a bare sign or blanks give the empty string.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.regexp_replace(F.trim(c), "^[@#]+", "")))
