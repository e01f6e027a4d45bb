"""Findings of all detectors: one schema, ids, clusters, tasks, layers, verdicts, grade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.ranks import padded, placed

RISKS = ["info", "low", "medium", "high", "critical"]
#: Id prefix of each category; categories without one have OTHER.
PREFIX = {
    "duplicate_numeric_columns": "DC", "fixed_difference": "FD", "fixed_ratio": "FR", "formula_derived_column": "FM",
    "row_offset_exact_reuse": "ROE", "row_offset_scalar_multiple": "ROS", "paired_ratio_reuse": "PRR", "duplicate_row_vector": "DRV",
    "long_format_paired_ratio_reuse": "LPR", "long_format_within_pair_ratio_enrichment": "LPE", "row_offset_partial_copy_rounding_bias": "RBR",
    "paired_difference_too_narrow": "PDS", "cross_block_paired_diff_too_narrow": "CBD", "repeated_measurement_value": "RMV",
    "fractional_tail_reuse": "FTR", "small_n_fixed_difference": "SNF", "small_n_fixed_ratio": "SNR", "cross_sheet_fractional_tail_reuse": "CFT",
    "binary_arithmetic_relation": "BAR", "shifted_paste": "SHP", "copy_paste_modify": "CPM", "internal_sequence_relation": "ISR",
    "decimal_tail_match_shifted": "DTS", "strict_linear_relation": "SLR",
}
OTHER = "PF"
#: Categories whose clusters are told apart by the value of their relation.
BY_RELATIONSHIP = (
    "row_offset_scalar_multiple", "row_offset_exact_reuse", "long_format_within_pair_ratio_enrichment", "row_offset_partial_copy_rounding_bias",
    "repeated_measurement_value", "fractional_tail_reuse", "small_n_fixed_difference", "small_n_fixed_ratio", "cross_sheet_fractional_tail_reuse",
    "binary_arithmetic_relation", "shifted_paste", "copy_paste_modify", "internal_sequence_relation", "decimal_tail_match_shifted", "strict_linear_relation",
)


def risk_rank(level: Column) -> Column:
    """critical 4 ... info 0; anything else ranks as info."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RISKS)), level), F.lit(0)) - 1, F.lit(0)).cast("int")


def risk_level(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), rank + 1)


#: Optional fields of a finding, and what they are if a detector doesn't say.
FIELDS = {"row_offset": "int", "relationship": "string", "width": "int", "support": "long", "overlap": "long", "support_rate": "double", "artifact_likelihood": "string"}


def unified(found: DataFrame, columns: Column) -> DataFrame:
    """Brings a detector's rows to the common schema; missing fields are null."""
    has = set(found.columns)
    pick = lambda name, kind: (F.col(name) if name in has else F.lit(None)).cast(kind).alias(name)
    return found.select("workbook", "sheet", "category", "risk_level", columns.alias("columns"), *[pick(*f) for f in FIELDS.items()])


def numbered(parts: list[DataFrame]) -> DataFrame:
    """All findings with ids PREFIX-0001 per category, by risk, workbook, sheet, columns,
    offset, relationship and support; from the 10,000th on an id has more digits. Findings
    are range-partitioned in that order and counted per partition, and a partition goes on
    where the ones before it stopped, so no task holds a whole category."""
    union = reduce(DataFrame.unionByName, parts).withColumn("rank", risk_rank(F.col("risk_level")))
    order = [-F.col("rank"), *map(F.col, ("workbook", "sheet", "columns", "row_offset", "relationship", "support"))]
    number = padded(F.col("_n"), 4)
    prefix = F.coalesce(F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])[F.col("category")], F.lit(OTHER))
    named = placed(union, order, ["category"], "_n").withColumn("finding_id", F.concat(prefix, F.lit("-"), number))
    return named.select(*union.columns, "finding_id")


def priority(findings: DataFrame) -> DataFrame:
    """Findings of medium risk or more that aren't held for artifacts."""
    return findings.filter((risk_rank(F.col("risk_level")) >= 2) & (F.coalesce("artifact_likelihood", F.lit("")) != "high"))


def signature() -> Column:
    """What tells the clusters of a category, sheet and offset apart: the value of the
    relation, a row's width, or nothing more."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    offset = F.concat(F.lit("offset="), text("row_offset"))
    related = F.concat(offset, F.lit(";relationship="), text("relationship"))
    return F.when(F.col("category").isin(*BY_RELATIONSHIP), related).when(F.col("category") == "duplicate_row_vector", F.concat(F.lit("width="), text("width"))).otherwise(offset)


def clusters(findings: DataFrame, representatives: int = 8) -> DataFrame:
    """One row per (category, workbook, sheet, offset, signature): size, summed support,
    highest rate and risk, and up to eight representative ids, riskiest first."""
    key = ["category", "workbook", "sheet", "row_offset", "signature"]
    ranked = findings.withColumn("signature", signature())
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("rank"), F.desc("support"), "finding_id")))
    some = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= representatives, F.struct("place", "finding_id")))), lambda x: x["finding_id"]), ",")
    return ranked.groupBy(*key).agg(F.count("*").alias("size"), F.sum("support").alias("support"), F.max("support_rate").alias("max_rate"), F.max("rank").alias("rank"), some.alias("representatives"))


def review_tasks(cluster: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` review tasks by risk and size, one per (category, workbook, sheet)."""
    tasks = cluster.groupBy("category", "workbook", "sheet").agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_findings"), F.max("rank").alias("rank"))
    return tasks.orderBy(F.desc("rank"), F.desc("n_findings"), "category", "workbook", "sheet").limit(top)


def layers(findings: DataFrame) -> DataFrame:
    """(layer, category, n) by ``reports.layer_of``."""
    from attesta.operators.reports import layer_of

    layer = layer_of(F.col("risk_level"), F.col("category"), F.lit(None).cast("string"))
    return findings.groupBy(layer.alias("layer"), "category").agg(F.count("*").alias("n"))


def risk_summary(findings: DataFrame) -> DataFrame:
    """Counts by risk and the overall level per workbook."""
    count = lambda k: F.count_if(F.col("rank") == k).alias(f"n_{RISKS[k]}")
    return findings.groupBy("workbook").agg(*[count(k) for k in range(5)], F.max("rank").alias("rank")).withColumn("overall", risk_level(F.col("rank"))).drop("rank")


#: Best grade that each tier of material allows.
TIER_CAP = {"full": "A", "partial": "B", "code_only": "C", "static": "C"}


#: Steps without which nothing is reproducible, and words of categories that
#: bear on the method.
CRITICAL_STEPS = ("discover", "material_inventory", "mineru", "evidence_ledger")
METHOD_WORDS = ("data_leakage", "statistical", "leakage")


def grade(runs: DataFrame, findings: DataFrame, tier: str) -> DataFrame:
    """(case_id, reproducibility, fidelity, methodology, interpretation, grade). ``runs`` has
    case_id, step, status; ``findings`` case_id, risk_level, category, issue_category.

    A failed critical step fails reproducibility, a failed source-data step warns.
    Consistency findings fail fidelity if one is critical or high, warn if one is medium,
    else pass with notes. Critical or high completeness findings, or first-layer findings
    about method, warn on methodology. A methodology review warns on interpretation; only
    third-layer findings pass it with notes. Grades fall from A over B (a warning) and C (a
    failure) to D (failed reproducibility) and are capped by tier; an unknown tier raises
    ValueError."""
    from attesta.operators.reports import layer_of

    if tier not in TIER_CAP:
        raise ValueError(f"unknown tier {tier!r}")
    failed = F.col("status") == "failed"
    steps = runs.groupBy("case_id").agg(F.max((failed & F.col("step").isin(*CRITICAL_STEPS)).cast("int")).alias("broken"), F.max((failed & F.col("step").startswith("source_data")).cast("int")).alias("partly"))
    rank, issue = risk_rank(F.col("risk_level")), F.coalesce("issue_category", F.lit(""))
    layer = layer_of(F.col("risk_level"), F.col("category"), F.lit(None).cast("string"))
    any_of = lambda c: F.max(c.cast("int"))
    risks = findings.groupBy("case_id").agg(
        F.max(F.when(issue == "consistency", rank)).alias("consistency"),
        any_of(((issue == "completeness") & (rank >= 3)) | ((layer == 1) & F.col("category").rlike("|".join(METHOD_WORDS)))).alias("method"),
        any_of(F.col("category") == "paperfraud.methodology_review").alias("reviewed"),
        any_of(layer < 3).alias("weighty"),
    )
    both = steps.join(risks, "case_id", "full")
    on = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    repro = F.when(on("broken"), "fail").when(on("partly"), "warning").otherwise("pass")
    fidelity = F.when(F.col("consistency") >= 3, "fail").when(F.col("consistency") == 2, "warning").when(F.col("consistency").isNotNull(), "pass_with_notes").otherwise("pass")
    method = F.when(on("method"), "warning").otherwise("pass")
    reading = F.when(on("reviewed"), "warning").when(F.col("weighty") == 0, "pass_with_notes").otherwise("pass")
    four = both.select("case_id", repro.alias("reproducibility"), fidelity.alias("fidelity"), method.alias("methodology"), reading.alias("interpretation"))
    states = F.array("reproducibility", "fidelity", "methodology", "interpretation")
    letter = F.when(F.col("reproducibility") == "fail", "D").when(F.array_contains(states, "fail"), "C").when(F.array_contains(states, "warning"), "B").otherwise("A")
    return four.withColumn("grade", F.greatest(letter, F.lit(TIER_CAP[tier])))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key: the read side of an upsert."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in others])


def expand_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with the latest verdict on their cluster (category, workbook, sheet):
    false positives are excluded, the rest stays active."""
    last = latest(verdicts, ["category", "workbook", "sheet"], ["seq"])
    met = findings.join(last.select("category", "workbook", "sheet", "verdict"), ["category", "workbook", "sheet"], "left")
    return met.withColumn("active", F.coalesce(F.col("verdict") != "false_positive", F.lit(True)))


def group_similar(findings: DataFrame) -> DataFrame:
    """Findings with the id of the group row that stands for them where two or more share
    (category, workbook, sheet); null for single ones."""
    w = Window.partitionBy("category", "workbook", "sheet")
    group = F.concat_ws(":", F.lit("G"), "category", "workbook", "sheet")
    return findings.withColumn("suppressed_by", F.when(F.count("*").over(w) >= 2, group))


def merge_claims(refined: DataFrame, derived: DataFrame) -> DataFrame:
    """Refined claims, and derived ones whose mapping no refined claim covers."""
    return refined.unionByName(derived.join(refined.select("mapping_id").distinct(), "mapping_id", "left_anti"))
