"""JSON functions. Paths are '$.a.b[0]'."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numeric import _c


def _parsed(s: str | None):
    try:
        return json.loads(s) if s is not None else None
    except ValueError:
        return None


def _holds(doc, value) -> bool:
    """Containment: arrays hold each element in any order, objects hold each member."""
    if isinstance(doc, list):
        return all(_holds(doc, v) for v in value) if isinstance(value, list) else any(_holds(d, value) for d in doc)
    if isinstance(doc, dict):
        return isinstance(value, dict) and all(k in doc and _holds(doc[k], v) for k, v in value.items())
    return not isinstance(value, (list, dict)) and doc == value and isinstance(doc, bool) == isinstance(value, bool)


def json_contains(doc, value) -> Column:
    """1 if the document holds the value, 0 if not, NULL if either is NULL or no JSON."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None if x is None or y is None or (p := _parsed(x)) is None and x != "null" or (q := _parsed(y)) is None and y != "null" else int(_holds(p, q)) for x, y in zip(a, b, strict=True)]
        return pd.Series(out, dtype="Int32")

    return run(_c(doc), value if isinstance(value, Column) else F.lit(value))


def json_extract(doc, path: str) -> Column:
    return F.get_json_object(_c(doc), path)


def json_quote(s) -> Column:
    """A string as a JSON string literal."""
    q = F.to_json(F.array(_c(s)))
    return F.when(_c(s).isNotNull(), F.substring(q, F.lit(2), F.char_length(q) - 2))


def json_array(*xs) -> Column:
    return F.to_json(F.array(*[_c(x) for x in xs]))


def path_steps(path: str) -> list[str | int]:
    """Steps of a path: member names and array positions; names may be quoted."""
    steps: list[str | int] = []
    at = 1
    if path[:1] != "$":
        raise ValueError(path)
    for m in re.finditer(r'\.(?:"([^"]*)"|([^.\[\]"]+))|\[(\d+)\]', path):
        if m.start() != at:
            raise ValueError(path)
        at = m.end()
        steps.append(int(m[3]) if m[3] else m[1] if m[1] is not None else m[2])
    if at != len(path):
        raise ValueError(path)
    return steps


def _put(doc, steps: list[str | int], value):
    """The document with the value at the path; missing members on the way are made, if a name follows."""
    if not steps:
        return value
    step, rest = steps[0], steps[1:]
    if isinstance(step, int):
        if not isinstance(doc, list):  # a single value counts as an array of one
            return _put(doc, rest, value) if step == 0 else doc if rest else [doc, value]
        if step < len(doc):
            return [*doc[:step], _put(doc[step], rest, value), *doc[step + 1 :]]
        return doc if rest else [*doc, value]
    if not isinstance(doc, dict) or (rest and step not in doc and isinstance(rest[0], int)):
        return doc
    return {**doc, step: _put(doc.get(step, {} if rest else None), rest, value)}


def json_set(doc, path: str, value) -> Column:
    """The document with the value at a path of names and array positions (``$.a[0].b``).

    An existing value is replaced; a missing member is added, with the members on the way to it; a
    position behind the end of an array appends. Where the way leads through another kind of value,
    or the text is no JSON, nothing changes. NULL stays NULL.
    """
    steps = path_steps(path)

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, v in zip(a, b, strict=True):
            if x is not None and ((d := _parsed(x)) is not None or x.strip() == "null"):
                x = json.dumps(_put(d, steps, v.item() if hasattr(v, "item") else v), ensure_ascii=False)
            out.append(x)
        return pd.Series(out, dtype=object)

    return run(_c(doc), value if isinstance(value, Column) else F.lit(value))
