"""Polygons against a grid of points and against known answers."""

import math
import random

from pyspark.sql import functions as F

from attesta.functions import geometry as g


def inside(polygon, x, y):
    """Whether a convex polygon, either way round, holds a point."""
    signs = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(polygon, polygon[1:] + polygon[:1])]
    return all(s >= 0 for s in signs) or all(s <= 0 for s in signs)


def quadrilateral(draw):
    """A convex one: four places on a circle, moved, and sometimes clockwise."""
    around = sorted(draw.uniform(0, 2 * math.pi) for _ in range(4))
    radius, cx, cy = draw.uniform(0.3, 1), draw.uniform(-0.5, 0.5), draw.uniform(-0.5, 0.5)
    points = [(cx + radius * math.cos(t), cy + radius * math.sin(t)) for t in around]
    return points[::-1] if draw.random() < 0.5 else points


def test_common_areas_against_a_grid(spark):
    draw = random.Random(2)
    rows = [(i, quadrilateral(draw), quadrilateral(draw)) for i in range(40)]
    df = spark.createDataFrame(rows, f"id int, a {g.POLYGON}, b {g.POLYGON}")
    got = {r.id: (r.common, r.part) for r in df.select("id", g.area(g.clip(F.col("a"), F.col("b"))).alias("common"), g.overlap(F.col("a"), F.col("b")).alias("part")).collect()}
    n, size = 300, 3.2
    for i, a, b in rows:
        grid = [(-1.6 + size * (k + 0.5) / n, -1.6 + size * (m + 0.5) / n) for k in range(n) for m in range(n)]
        cells = sum(inside(a, x, y) and inside(b, x, y) for x, y in grid) * (size / n) ** 2
        assert abs(got[i][0] - cells) < 0.03
        assert 0 <= got[i][1] <= 1 + 1e-9


def test_known_and_degenerate_polygons(spark):
    square, turned = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(1.0, -1.0), (3.0, 1.0), (1.0, 3.0), (-1.0, 1.0)]
    rows = [(0, square, square), (1, square, turned), (2, square, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]), (3, square, [(0.0, 0.0), (1.0, 1.0)]), (4, [], square), (5, square[::-1], [(1.0, 1.0), (1.0, 9.0), (9.0, 9.0), (9.0, 1.0)]), (6, square, None)]
    df = spark.createDataFrame(rows, f"id int, a {g.POLYGON}, b {g.POLYGON}")
    got = {r.id: r.common for r in df.select("id", g.area(g.clip(F.col("a"), F.col("b"))).alias("common")).collect()}
    assert {i: round(x, 9) for i, x in got.items() if x is not None} == {0: 4, 1: 4, 2: 0, 3: 0, 4: 0, 5: 1, **({6: 0} if got[6] is not None else {})}


def test_projection(spark):
    one = g.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    shown = lambda h: [tuple(p) for p in spark.range(1).select(g.project(one, F.array(*map(F.lit, h))).alias("p")).first().p or ()]
    assert shown([2.0, 0.0, 1.0, 0.0, 3.0, -1.0, 0.0, 0.0, 1.0]) == [(1, -1), (3, -1), (3, 2), (1, 2)]
    assert shown([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0]) == [(0, 0), (0.5, 0), (0.5, 0.5), (0, 1)]
    assert shown([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, -2.0, 0.0, 1.0]) == []
    assert shown([1.0, 2.0]) == []
