"""Geometry: points are struct(x, y), lines arrays of points, polygons arrays of rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numeric import _c

POINT = "struct<x:double,y:double>"


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def linestring(*points: Column) -> Column:
    return F.array(*points)


def polygon(*rings: Column) -> Column:
    return F.array(*rings)


def st_x(p) -> Column:
    return _c(p)["x"]


def st_y(p) -> Column:
    return _c(p)["y"]


def _pairs(text: Column) -> Column:
    """'x y,x y' to an array of points."""
    return F.transform(F.split(text, r"\s*,\s*"), lambda s: F.struct(F.split(F.trim(s), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(s), r"\s+")[1].try_cast("double").alias("y")))


def point_from_text(s) -> Column:
    """ST_GeomFromText of a POINT; NULL for other text."""
    body = F.regexp_extract(_c(s), r"(?i)^\s*POINT\s*\(([^()]*)\)\s*$", 1)
    return F.when(body != "", _pairs(body)[0])


def line_from_text(s) -> Column:
    body = F.regexp_extract(_c(s), r"(?i)^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
    return F.when(body != "", _pairs(body))


def polygon_from_text(s) -> Column:
    body = F.regexp_extract(_c(s), r"(?i)^\s*POLYGON\s*\(\s*(\(.*\))\s*\)\s*$", 1)
    return F.when(body != "", F.transform(F.split(F.regexp_replace(body, r"^\(|\)$", ""), r"\)\s*,\s*\("), _pairs))


def _number(d: Column) -> Column:
    """Shortest text of a double without a trailing '.0'."""
    return F.regexp_replace(d.cast("string"), r"\.0$", "")


def point_as_text(p) -> Column:
    p = _c(p)
    return F.concat(F.lit("POINT("), _number(p["x"]), F.lit(" "), _number(p["y"]), F.lit(")"))


def mbr(points) -> Column:
    """Bounding box of an array of points: struct(x0, y0, x1, y1)."""
    p = _c(points)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def mbr_within(a, b) -> Column:
    """1 if box a lies in box b."""
    a, b = _c(a), _c(b)
    return ((a["x0"] >= b["x0"]) & (a["x1"] <= b["x1"]) & (a["y0"] >= b["y0"]) & (a["y1"] <= b["y1"])).cast("int")


def mbr_contains(a, b) -> Column:
    return mbr_within(b, a)


def mbr_equals(a, b) -> Column:
    return (_c(a) == _c(b)).cast("int")


def _edges(ring: Column) -> Column:
    """Pairs of neighbouring points (a, b) of a line."""
    return F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))


def st_on_line(p, line) -> Column:
    """1 if a point lies on a line (array of points)."""
    p = _c(p)

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straight = (b["x"] - a["x"]) * (p["y"] - a["y"]) == (b["y"] - a["y"]) * (p["x"] - a["x"])
        between = lambda k: (p[k] >= F.least(a[k], b[k])) & (p[k] <= F.greatest(a[k], b[k]))
        return straight & between("x") & between("y")

    return F.exists(_edges(_c(line)), on).cast("int")


def st_within(p, ring) -> Column:
    """1 if a point lies inside a ring (array of points, closed), its border not included; even-odd rule, in array functions."""
    p, ring = _c(p), _c(ring)

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        at = (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return spans & (p["x"] < at)

    inside = (F.size(F.filter(_edges(ring), crosses)) % 2).cast("int")
    return F.when(st_on_line(p, ring) == 1, 0).otherwise(inside)


def st_within_polygon(p, polygon_) -> Column:
    """1 if a point lies inside a polygon (array of rings: the outer one, then holes); borders are not inside."""
    rings = _c(polygon_)
    hole = F.exists(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: (st_within(p, r) == 1) | (st_on_line(p, r) == 1))
    return F.when(hole, 0).otherwise(st_within(p, rings[0]))


def st_contains(polygon_, p) -> Column:
    """1 if a polygon contains a point."""
    return st_within_polygon(p, polygon_)


def line_as_text(line) -> Column:
    q = F.transform(_c(line), lambda p: F.concat(_number(p["x"]), F.lit(" "), _number(p["y"])))
    return F.concat(F.lit("LINESTRING("), F.array_join(q, ","), F.lit(")"))
