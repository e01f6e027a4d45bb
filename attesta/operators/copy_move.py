"""What becomes of keypoint results: copied regions within and between images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.ranks import padded, placed

#: Keypoints at which a copy within one image scores one.
FULL_SCORE = 200
#: A rotation is estimated from ten matches or more.
ROTATION_LEAST = 10
#: Kinds of relationships in the order in which ties stand, and their methods.
KINDS = ("copy_move_single", "copy_move_cross", "copy_move_rotation")
METHODS = ("rootsift_magsac_single", "rootsift_magsac_cross", "sift_ransac_affine")
UNKNOWN = "unknown"


def figure_types(panels: DataFrame) -> DataFrame:
    """(figure_id, types): the kinds of panels that a figure holds, sorted. Panels without
    figure or type are left out; kinds are few, so a figure's set is small."""
    known = panels.filter((F.col("figure_id").cast("string") != "") & (F.col("panel_type") != ""))
    return known.groupBy("figure_id").agg(F.array_sort(F.collect_set("panel_type")).alias("types"))


def _kept(rows: DataFrame, count: str, least: int, score: Column, least_score: float) -> DataFrame:
    """Successful results with enough keypoints and score; a missing count or score is
    zero. The limits hold for the score itself, which is rounded afterwards."""
    scored = rows.withColumns({"_count": F.coalesce(F.col(count), F.lit(0)), "_score": F.coalesce(score, F.lit(0.0))})
    return scored.filter("success AND found").filter((F.col("_count") >= least) & (F.col("_score") >= least_score))


def _common(kind: int, source: Column, target: Column, overlay: Column, flipped: Column) -> list[Column]:
    empty = F.nullif(overlay, F.lit(""))
    return [
        F.lit(kind).alias("_kind"), F.lit(KINDS[kind]).alias("source_type"), F.lit(METHODS[kind]).alias("match_method"),
        source.cast("string").alias("source"), target.cast("string").alias("target"), (F.rint(F.col("_score") * 10_000) / 10_000).alias("score"),
        F.col("_count").cast("long").alias("inlier_count"), empty.alias("overlay_source"), F.coalesce(flipped, F.lit(False)).alias("flip_detected"),
    ]


def _typed(relations: DataFrame, types: DataFrame) -> DataFrame:
    """The kinds of panels on both sides and those in common, as comma-separated text."""
    side = lambda s: types.select(F.col("figure_id").cast("string").alias(s), F.col("types").alias(f"_{s}"))
    met = relations.join(side("source"), "source", "left").join(side("target"), "target", "left")
    text = lambda c: F.coalesce(F.nullif(F.array_join(c, ","), F.lit("")), F.lit(UNKNOWN))
    return met.withColumns({"source_panel_type": text(F.col("_source")), "target_panel_type": text(F.col("_target")), "matched_panel_types": text(F.array_sort(F.array_intersect("_source", "_target")))}).drop("_source", "_target")


def relationships(singles: DataFrame, crosses: DataFrame, rotations: DataFrame, types: DataFrame, least: int = 10, least_score: float = 0.5, top: int = 500) -> DataFrame:
    """Relationships IR-0001 and on by falling score, of three families of results, each
    with ``success`` and ``found``:

    - ``singles`` (panel_id, keypoints, matches_path, mask_path, n_clusters): copies within
      a panel score their keypoints over 200, one at most;
    - ``crosses`` (source, target, keypoints, shared_source, shared_target, n_source,
      n_target, matches_path, flipped): two figures score their smaller common area;
    - ``rotations`` (source, target, inliers, score, matrix, angle, scale, flipped): a pair
      brings its own score and its transform, and needs ten inliers whatever ``least`` is.

    ``types`` is ``figure_types``. A result is left out below ``least`` keypoints or
    ``least_score``. Ties stand by family, source, target, keypoints and overlay; a
    relationship's overlay gets a name of its own, as results of different panels may share
    a file name. All are returned: ``reported`` marks the first ``top``."""
    none = F.lit(None)
    one = _kept(singles, "keypoints", least, F.least(F.lit(1.0), F.col("keypoints") / float(FULL_SCORE)), least_score)
    overlay = F.coalesce(F.nullif("matches_path", F.lit("")), "mask_path")
    detail = {"shared_source": "double", "shared_target": "double", "n_source": "long", "n_target": "long", "matrix": "array<double>", "angle": "double", "scale": "double"}

    def fields(**own: Column) -> list[Column]:
        return [own.get(name, none).cast(kind).alias(name) for name, kind in detail.items()]

    parts = [one.select(*_common(0, F.col("panel_id"), F.col("panel_id"), overlay, F.lit(False)), *fields(n_source=F.coalesce("n_clusters", F.lit(0))))]
    two = _kept(crosses, "keypoints", least, F.least(F.coalesce("shared_source", F.lit(0.0)), F.coalesce("shared_target", F.lit(0.0))), least_score)
    rounded = lambda c: F.rint(F.coalesce(c, F.lit(0.0)) * 10_000) / 10_000
    of_two = fields(shared_source=rounded("shared_source"), shared_target=rounded("shared_target"), n_source=F.coalesce("n_source", F.lit(0)), n_target=F.coalesce("n_target", F.lit(0)))
    parts.append(two.select(*_common(1, F.col("source"), F.col("target"), F.col("matches_path"), F.col("flipped")), *of_two))
    turned = _kept(rotations, "inliers", max(least, ROTATION_LEAST), F.col("score"), least_score)
    of_turned = fields(matrix=F.col("matrix"), angle=F.coalesce("angle", F.lit(0.0)), scale=F.coalesce("scale", F.lit(1.0)))
    parts.append(turned.select(*_common(2, F.col("source"), F.col("target"), F.lit(None).cast("string"), F.col("flipped")), *of_turned))
    between = _typed(parts[1].unionByName(parts[2]), types)
    every = between.unionByName(parts[0], allowMissingColumns=True)
    ordered = placed(every, [F.desc("score"), "_kind", "source", "target", F.desc("inlier_count"), "overlay_source", "angle", "scale"], name="_n")
    folder, suffix = F.regexp_extract("overlay_source", r"^(.*/)?", 0), F.coalesce(F.nullif(F.regexp_extract("overlay_source", r"[^/.][^/]*(\.[^/.]+)$", 1), F.lit("")), F.lit(".png"))
    unique = F.concat(folder, F.lit("rel_"), padded(F.col("_n") - 1, 4), F.lit("_overlay"), suffix)
    return ordered.select(F.concat(F.lit("IR-"), padded(F.col("_n"), 4)).alias("relationship_id"), *[c for c in every.columns if c != "_kind"], unique.alias("overlay_path"), (F.col("_n") <= top).alias("reported"))


def failures(singles: DataFrame, crosses: DataFrame, rotations: DataFrame) -> DataFrame:
    """(family, source, target, error) of results that failed with a message."""
    side = lambda df, name, source, target: df.filter("NOT coalesce(success, false) AND error <> ''").select(F.lit(name).alias("family"), F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"), "error")
    return side(singles, "single", "panel_id", "panel_id").unionByName(side(crosses, "cross", "source", "target")).unionByName(side(rotations, "rotation", "source", "target"))
