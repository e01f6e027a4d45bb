"""Panels, image relationships and what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.scalars import clamp, image_risk, min_rotation_distance
from attesta.operators.findings import RISKS, risk_level, risk_rank

#: Panel types that can't hold copied image content, and those whose risk is capped.
SKIPPED = ("Graphs",)
CAPPED = ("Graphs", "Flow")
RANK = {name: k for k, name in enumerate(RISKS)}


def over_segmented(panels: DataFrame, limit: int = 16) -> DataFrame:
    """Figures with more panels than a figure has."""
    return panels.groupBy("figure_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit)


def rotation_pairs(panels: DataFrame, limit: int = 20) -> DataFrame:
    """(case_id, a, b, distance): panels of one case in different figures whose types
    overlap and whose rotated hashes come within ``limit`` bits. A case is one paper, so
    the join on case_id meets as many panels as a paper has."""
    left = panels.select("case_id", F.struct("panel_id", "figure_id", "types", "rotations").alias("x"))
    right = panels.select("case_id", F.struct("panel_id", "figure_id", "types", "rotations").alias("y"))
    met = left.join(right, "case_id").filter((F.col("x.panel_id") < F.col("y.panel_id")) & (F.col("x.figure_id") != F.col("y.figure_id")) & F.arrays_overlap("x.types", "y.types"))
    scored = met.withColumn("distance", min_rotation_distance(F.col("x.rotations"), F.col("y.rotations")))
    return scored.filter(F.col("distance") <= limit).select("case_id", F.col("x.panel_id").alias("a"), F.col("y.panel_id").alias("b"), "distance")


def verified(matches: DataFrame, inliers: int = 10, overlap: float = 0.01, top: int = 500) -> DataFrame:
    """Keypoint matches (source, target, inliers, overlap_source, overlap_target) with
    enough inliers and common area, best first; the score is inliers over 200."""
    good = matches.filter((F.col("inliers") >= inliers) & ((F.col("overlap_source") >= overlap) | (F.col("overlap_target") >= overlap)))
    scored = good.withColumn("score", clamp(F.col("inliers") / 200.0))
    return scored.orderBy(F.desc("score"), "source", "target").limit(top)


def visual_findings(relations: DataFrame, panels: DataFrame, least: float = 0.4) -> DataFrame:
    """(source, target, score, risk_level): relations of panels (panel_id, panel_type,
    fallback) by their dominant type. Copied regions in graphs are left out; graphs and
    flow plots reach medium at most, overlaps high, panels without a real crop medium and
    a score of 0.39."""
    side = lambda s: panels.select(F.col("panel_id").alias(s), F.col("panel_type").alias(f"type_{s}"), F.col("fallback").alias(f"fallback_{s}"))
    met = relations.join(side("source"), "source").join(side("target"), "target")
    skipped = F.col("method").isin("copy_move", "overlap") & F.col("type_source").isin(*SKIPPED)
    met = met.filter((F.col("score") >= least) & ~skipped)
    fallback = F.col("fallback_source") | F.col("fallback_target")
    rank = risk_rank(image_risk(F.col("score"), F.col("type_source")))
    cap = F.when(fallback | F.col("type_source").isin(*CAPPED), RANK["medium"]).when(F.col("method") == "overlap", RANK["high"]).otherwise(RANK["critical"])
    return met.select("source", "target", "method", F.when(fallback, F.least("score", F.lit(0.39))).otherwise(F.col("score")).alias("score"), risk_level(F.least(rank, cap)).alias("risk_level"))


def provenance_findings(edges: DataFrame, least: float = 0.85, top: int = 30) -> DataFrame:
    """The ``top`` provenance edges by the first score they have."""
    score = F.coalesce("score", "weight", "cosine")
    return edges.withColumn("strength", score).filter(F.col("strength") >= least).orderBy(F.desc("strength"), "source", "target").limit(top).select("source", "target", "strength")


def provenance_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean weight, share of flipped matches."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.avg("weight").alias("mean_weight"), F.count_if("flipped").alias("n_flipped"))
    return n.crossJoin(e)


def wet_lab(panels: DataFrame, classes: DataFrame, unknown: bool = False) -> DataFrame:
    """Panels whose figure is wet-lab or mixed; ``unknown`` figures count if asked for."""
    kept = ["wet_lab", "mixed", *["unknown"] * unknown]
    return panels.join(classes.filter(F.col("class").isin(*kept)).select("figure_id"), "figure_id", "left_semi")


def panel_class(panels: DataFrame, by_panel: DataFrame, by_figure: DataFrame) -> DataFrame:
    """The class of a panel's own row, else its figure's, else unknown."""
    met = panels.join(by_panel.select("panel_id", F.col("class").alias("own")), "panel_id", "left").join(by_figure.select("figure_id", F.col("class").alias("figures")), "figure_id", "left")
    return met.withColumn("class", F.coalesce("own", "figures", F.lit("unknown"))).drop("own", "figures")
