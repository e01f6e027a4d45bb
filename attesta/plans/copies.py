"""Copied regions on the driver's tables, with their SQL: parts are panels that were
searched in themselves, vectors figures that were compared with another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import copy_move
from attesta.plans.sheets import read

_TYPES = ("Blots", "Graphs", "Flow", "Microscopy", "Body")


def families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Results within parts, between vectors, of turned vectors, and the figures' kinds."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("out/"), (k % 40).cast("string"), F.when(k % 5 == 0, "/crop").otherwise("/crop.jpg"))
    singles = read(spark, sf_dir, "part").select(
        k.alias("panel_id"), (k % 13 != 0).alias("success"), (k % 7 != 0).alias("found"), F.when(k % 17 != 0, F.col("p_size") * 5).alias("keypoints"),
        F.when(k % 3 == 0, path).otherwise("").alias("matches_path"), F.when(k % 3 == 1, path).alias("mask_path"), (k % 4).alias("n_clusters"), F.when(k % 26 == 0, F.concat(F.lit("unreadable "), k.cast("string"))).alias("error"),
    )
    e = read(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    at = lambda i, times: F.least(F.lit(1.0), F.abs(F.get("embedding", F.lit(i)).cast("double")) * times)
    both = [v.alias("source"), (v * 7 % 500).alias("target"), (v % 11 != 0).alias("success"), (v % 2 == 0).alias("flipped"), F.when(v % 22 == 0, "no overlap").alias("error")]
    crosses = e.select(*both, (v % 5 != 0).alias("found"), (v % 60).alias("keypoints"), at(0, 6.0).alias("shared_source"), at(1, 6.0).alias("shared_target"), (v % 3).alias("n_source"), (v % 4).alias("n_target"), F.concat(F.lit("pairs/"), (v % 9).cast("string"), F.lit(".png")).alias("matches_path"))
    rotations = e.select(*both, (v % 4 != 0).alias("found"), (v % 50).alias("inliers"), at(2, 6.0).alias("score"), F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")).alias("matrix"), (v % 360).cast("double").alias("angle"), F.lit(None).cast("double").alias("scale"))
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("label") % 5 + 1).cast("int"))
    panels = e.select((v % 500).alias("figure_id"), F.when(v % 3 != 0, kind).alias("panel_type"))
    return singles, crosses, rotations, copy_move.figure_types(panels)


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every relationship, without its transform."""
    return copy_move.relationships(*families(spark, sf_dir)).drop("matrix")


_SQL = f"""WITH k AS (SELECT vec_id % 500 AS figure_id, list_sort(list(DISTINCT {list(_TYPES)}[label % 5 + 1])) AS types FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY ALL),
    s AS (SELECT p_partkey AS id, p_size * 5 AS n, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE 'out/' || (p_partkey % 40) || CASE WHEN p_partkey % 5 = 0 THEN '/crop' ELSE '/crop.jpg' END END AS path FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 17 <> 0),
    e AS (SELECT vec_id AS v, least(1.0::DOUBLE, abs(embedding[1]::DOUBLE) * 6) AS x, least(1.0::DOUBLE, abs(embedding[2]::DOUBLE) * 6) AS y, least(1.0::DOUBLE, abs(embedding[3]::DOUBLE) * 6) AS z FROM embeddings WHERE vec_id % 11 <> 0),
    b AS (
        SELECT 1 AS kind, v AS source, v * 7 % 500 AS target, v % 60 AS n, least(coalesce(x, 0), coalesce(y, 0)) AS score, 'pairs/' || (v % 9) || '.png' AS path, v % 2 = 0 AS flipped, x, y, v % 3 AS n_source, v % 4 AS n_target, NULL::DOUBLE AS angle, NULL::DOUBLE AS scale FROM e WHERE v % 5 <> 0
        UNION ALL SELECT 2, v, v * 7 % 500, v % 50, coalesce(z, 0), NULL, v % 2 = 0, NULL, NULL, NULL, NULL, v % 360, 1 FROM e WHERE v % 4 <> 0),
    t AS (SELECT b.*, coalesce(array_to_string(p.types, ','), 'unknown') AS source_panel_type, coalesce(array_to_string(q.types, ','), 'unknown') AS target_panel_type, coalesce(nullif(array_to_string(list_sort(list_intersect(p.types, q.types)), ','), ''), 'unknown') AS matched_panel_types
          FROM b LEFT JOIN k p ON p.figure_id = source LEFT JOIN k q ON q.figure_id = target WHERE n >= 10 AND score >= 0.5),
    u AS (SELECT * FROM t UNION ALL SELECT 0, id, id, n, least(1, n / 200.0), path, false, NULL, NULL, id % 4, NULL, NULL, NULL, NULL, NULL, NULL FROM s WHERE n >= 10 AND least(1, n / 200.0) >= 0.5),
    w AS (SELECT kind, source::VARCHAR AS source, target::VARCHAR AS target, round_even(score * 10000, 0) / 10000 AS score, n::BIGINT AS inlier_count, path AS overlay_source, flipped AS flip_detected, round_even(x * 10000, 0) / 10000 AS shared_source, round_even(y * 10000, 0) / 10000 AS shared_target,
                 n_source::BIGINT AS n_source, n_target::BIGINT AS n_target, angle, scale, source_panel_type, target_panel_type, matched_panel_types FROM u),
    o AS (SELECT *, row_number() OVER (ORDER BY score DESC, kind, source, target, inlier_count DESC, overlay_source NULLS FIRST, angle NULLS FIRST, scale NULLS FIRST) AS i FROM w)
    SELECT 'IR-' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS relationship_id, {list(copy_move.KINDS)}[kind + 1] AS source_type, {list(copy_move.METHODS)}[kind + 1] AS match_method, * EXCLUDE (kind, i),
           CASE WHEN overlay_source IS NOT NULL THEN split_part(overlay_source, '/', 1) || CASE WHEN kind = 0 THEN '/' || split_part(overlay_source, '/', 2) ELSE '' END || '/rel_' || CASE WHEN i <= 1000 THEN lpad((i - 1)::VARCHAR, 4, '0') ELSE (i - 1)::VARCHAR END || '_overlay' || CASE WHEN overlay_source LIKE '%.jpg' THEN '.jpg' ELSE '.png' END END AS overlay_path,
           i <= 500 AS reported FROM o"""


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_move.failures(*families(spark, sf_dir)[:3])


_FAILURES_SQL = """SELECT 'single' AS family, p_partkey::VARCHAR AS source, p_partkey::VARCHAR AS target, 'unreadable ' || p_partkey AS error FROM part WHERE p_partkey % 26 = 0
    UNION ALL SELECT unnest(['cross', 'rotation']), vec_id::VARCHAR, (vec_id * 7 % 500)::VARCHAR, 'no overlap' FROM embeddings WHERE vec_id % 22 = 0"""

QUERIES = {"copy_move": copies, "copy_move_failures": failures}
SQL = {"copy_move": _SQL, "copy_move_failures": _FAILURES_SQL}
