"""Polygons as arrays of points, as columns: projection, clipping, area, overlap.

A polygon is array<struct<x:double,y:double>>; its last point is joined to its first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGON = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(left: Column, top: Column, width: Column, height: Column) -> Column:
    """The four corners of a box."""
    return F.array(point(left, top), point(left + width, top), point(left + width, top + height), point(left, top + height))


def project(polygon: Column, matrix: Column, eps: float = 1e-12) -> Column:
    """``polygon`` under a homography, the nine numbers of its matrix row by row. Null if
    the matrix has another size, or a point goes to infinity or lies behind the plane that
    another one lies before."""
    h = lambda k: F.get(matrix, F.lit(k)).cast("double")
    depth = lambda p: h(6) * p["x"] + h(7) * p["y"] + h(8)
    fine = (F.size(matrix) == 9) & (F.forall(polygon, lambda p: depth(p) > eps) | F.forall(polygon, lambda p: depth(p) < -eps))
    moved = F.transform(polygon, lambda p: point((h(0) * p["x"] + h(1) * p["y"] + h(2)) / depth(p), (h(3) * p["x"] + h(4) * p["y"] + h(5)) / depth(p)))
    return F.when(fine, moved)


def _next(polygon: Column, i: Column) -> Column:
    return F.get(polygon, (i + 1) % F.size(polygon))


def _cross(a: Column, b: Column, p: Column) -> Column:
    """Positive where ``p`` lies to the left of the way from ``a`` to ``b``."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def signed_area(polygon: Column) -> Column:
    """Half the sum of the cross products of neighbours, positive counterclockwise; zero
    for fewer than three points."""

    def held(poly: Column) -> Column:
        parts = F.transform(poly, lambda p, i: p["x"] * _next(poly, i)["y"] - _next(poly, i)["x"] * p["y"])
        return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x) / 2

    return F.when(F.size(polygon) < 3, F.lit(0.0)).otherwise(F.get(F.transform(F.array(polygon), held), F.lit(0)))


def area(polygon: Column) -> Column:
    return F.abs(signed_area(polygon))


def clip(polygon: Column, window: Column) -> Column:
    """The part of ``polygon`` inside the convex ``window``, whichever way round they are
    given: the edges of the window cut one after the other, and each keeps the points on
    its inner side and adds the places where the outline crosses it. Empty if either has
    fewer than three points or nothing is common."""
    ccw = F.when(signed_area(window) < 0, F.reverse(window)).otherwise(window)
    edges = lambda w: F.transform(w, lambda a, i: F.struct(a.alias("a"), _next(w, i).alias("b")))

    def cut(poly: Column, edge: Column) -> Column:
        def kept(p: Column, i: Column) -> Column:
            q = _next(poly, i)
            here, there = _cross(edge["a"], edge["b"], p), _cross(edge["a"], edge["b"], q)
            share = here / (here - there)
            met = point(p["x"] + share * (q["x"] - p["x"]), p["y"] + share * (q["y"] - p["y"]))
            own = F.when(here >= 0, F.array(p)).otherwise(F.array().cast(POLYGON))
            return F.when((here >= 0) != (there >= 0), F.concat(own, F.array(met))).otherwise(own)

        return F.flatten(F.transform(poly, kept))

    able = (F.size(polygon) >= 3) & (F.size(window) >= 3)
    cuts = F.flatten(F.transform(F.array(ccw), edges))
    return F.when(able, F.aggregate(cuts, polygon, cut)).otherwise(F.array().cast(POLYGON))


def overlap(left: Column, right: Column) -> Column:
    """The common area of ``left`` and the convex ``right`` as a part of the smaller one;
    zero if one of them has no area."""
    least = F.least(area(left), area(right))
    return F.when(least > 0, area(clip(left, right)) / least).otherwise(F.lit(0.0))
