"""Projected panels and their overlaps on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import geometry as g
from attesta.plans import sheets


def panel_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's components as a homography of the unit panel, against a panel turned by
    another component: the areas of both and of their common part, in millionths."""
    e = sheets.read(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL")
    x = lambda k, times=1.0: F.get("embedding", F.lit(k)).cast("double") * times
    one = F.lit(1.0)
    matrix = F.array(one + x(0), x(1, 0.3), x(2), x(3, 0.3), one + x(4), x(5), x(6, 0.1), x(7, 0.1), one)
    turn = x(8, 3.0)
    corner = lambda u, v: g.point(F.lit(0.5) + F.cos(turn) * u - F.sin(turn) * v, F.lit(0.5) + F.sin(turn) * u + F.cos(turn) * v)
    target = F.array(corner(-0.5, -0.5), corner(0.5, -0.5), corner(0.5, 0.5), corner(-0.5, 0.5))
    zero = F.lit(0.0)
    placed = e.select("vec_id", g.project(g.box(zero, zero, one, one), matrix).alias("source"), target.alias("target"))
    micro = lambda c: F.rint(c * 1e6).cast("long")
    return placed.select("vec_id", micro(g.area(F.col("source"))).alias("source_area"), micro(g.area(F.col("target"))).alias("target_area"), micro(g.area(g.clip(F.col("source"), F.col("target")))).alias("common_area"))


def _step(k: int) -> str:
    """Cuts the polygons of step k - 1 by edge k of the target."""
    return f"""side{k} AS (
        SELECT p.*, (bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax) AS here FROM poly{k - 1} p JOIN edges e ON e.vec_id = p.vec_id AND e.k = {k}),
    pair{k} AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, coalesce(lead(here) OVER w, first_value(here) OVER w) AS there FROM side{k} WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
    poly{k} AS (
        SELECT vec_id, 2 * i AS i, x, y FROM pair{k} WHERE here >= 0
        UNION ALL SELECT vec_id, 2 * i + 1, x + here / (here - there) * (nx - x), y + here / (here - there) * (ny - y) FROM pair{k} WHERE (here >= 0) <> (there >= 0))"""


def _area(name: str, source: str) -> str:
    return f"""{name} AS (
        SELECT vec_id, abs(sum(x * ny - nx * y)) / 2 AS area FROM (
            SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM {source} WINDOW w AS (PARTITION BY vec_id ORDER BY i)) GROUP BY vec_id)"""


_SQL = f"""WITH h AS (
        SELECT vec_id, 1 + embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE * 0.3::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE * 0.3::DOUBLE AS d, 1 + embedding[5]::DOUBLE AS e, embedding[6]::DOUBLE AS f,
               embedding[7]::DOUBLE * 0.1::DOUBLE AS g, embedding[8]::DOUBLE * 0.1::DOUBLE AS h, embedding[9]::DOUBLE * 3 AS t FROM embeddings WHERE embedding IS NOT NULL),
    corners AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) AS v(i, u, v)),
    poly0 AS (SELECT vec_id, i::BIGINT AS i, (a * u + b * v + c) / (g * u + h * v + 1) AS x, (d * u + e * v + f) / (g * u + h * v + 1) AS y FROM h, corners),
    target AS (SELECT vec_id, i::BIGINT AS i, 0.5 + cos(t) * (u - 0.5) - sin(t) * (v - 0.5) AS x, 0.5 + sin(t) * (u - 0.5) + cos(t) * (v - 0.5) AS y FROM h, corners),
    edges AS (
        SELECT vec_id, i + 1 AS k, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_ FROM target WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
    {", ".join(_step(k) for k in range(1, 5))},
    {_area("s", "poly0")}, {_area("t", "target")}, {_area("m", "poly4")}
    SELECT vec_id, CAST(round_even(s.area * 1e6, 0) AS BIGINT) AS source_area, CAST(round_even(t.area * 1e6, 0) AS BIGINT) AS target_area, CAST(round_even(coalesce(m.area, 0) * 1e6, 0) AS BIGINT) AS common_area
    FROM s JOIN t USING (vec_id) LEFT JOIN m USING (vec_id)"""

QUERIES = {"panel_overlaps": panel_overlaps}
SQL = {"panel_overlaps": _SQL}
