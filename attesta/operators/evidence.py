"""Evidence items with their indexes, and findings grouped for a report. A case is one
paper's audit; every input has a case_id, and rows without one are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.ranks import padded, placed

#: Files of an audit that are evidence by themselves, in their order.
ARTIFACTS = (
    "full.md", "material_inventory.json", "agent_material_plan.json", "evidence_ledger.json", "numeric_forensics.json", "paperfraud_rule_matches.json",
    "source_data_profile.json", "source_data_findings.json", "source_data_pair_forensics.json", "exact_image_duplicates.json",
    "image_similarity_candidates.json", "visual_evidence.json", "panel_evidence.json", "visual_copy_move.json", "image_relationships.json",
    "visual_findings.json", "forged_region_evidence.json", "investigation_rounds.jsonl",
)
#: Prefixes of the sources' ids, in the order in which items are numbered.
SOURCES = ("ART", "FIG", "PANEL", "SD", "PF")
#: Key of the pattern that a category's findings belong to.
PATTERNS = {
    "row_offset_scalar_multiple": "paired_offset_ratio_reuse",
    "long_format_paired_ratio_reuse": "paired_offset_ratio_reuse",
    "long_format_within_pair_ratio_enrichment": "paired_offset_ratio_reuse",
    "duplicate_row_vector": "row_vector_reuse",
    "row_offset_partial_copy_rounding_bias": "partial_copy_rounding_bias",
    "duplicate_numeric_columns": "duplicate_numeric_columns",
    "formula_derived_column": "formula_derivation",
    "formula_derived_columns": "formula_derivation",
    "fixed_ratio": "formula_derivation",
    "fixed_difference": "formula_derivation",
    "binary_arithmetic_relation": "formula_derivation",
    "strict_linear_relation": "formula_derivation",
    "shifted_paste": "small_n_publication_patterns",
    "copy_paste_modify": "small_n_publication_patterns",
    "internal_sequence_relation": "small_n_publication_patterns",
    "decimal_tail_match_shifted": "small_n_publication_patterns",
}
#: Words of a category or a source file that place findings of other categories.
WORDS = {
    "visual_forensics": ("image", "visual", "panel", "trufor", "copy_move", "cbir", "similarity", "overlap"),
    "numeric_forensics": ("numeric", "benford", "number"),
    "execution_evidence": ("execution", "command", "runtime"),
}
#: Order of the patterns in a report; a pattern of one category comes seventh.
ORDER = {
    "paired_offset_ratio_reuse": 0, "row_vector_reuse": 1, "duplicate_numeric_columns": 2, "partial_copy_rounding_bias": 3,
    "small_n_publication_patterns": 4, "row_vector_reuse_rounding": 5, "formula_derivation": 6, "visual_forensics": 7,
    "numeric_forensics": 8, "execution_evidence": 9, "other": 10,
}
SINGLE = 7
#: Categories shown as context, and scores of the levels that are shown.
CONTEXT = ("duplicate_row_vector",)
SHOWN = ("info", "context", "low", "medium", "high", "critical")
#: An id as findings have it.
FINDING_ID = r"[A-Z]{2,3}-[0-9]{4,}"


def _chosen(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def items(artifacts: DataFrame, figures: DataFrame, panels: DataFrame, relations: DataFrame, pairs: DataFrame, top: int = 100) -> DataFrame:
    """Evidence items of every case, numbered through a case from EV-ART-0001 on:
    ``artifacts`` (case_id, name, path, bytes) with one of the known names; ``figures``
    (case_id, seq, figure_id, path, label, page); ``panels`` (case_id, seq, panel_id,
    figure_id, path, label); and the ``top`` first findings of ``relations`` and of ``pairs``
    each (case_id, seq, finding_id, workbook, sheet, columns, row_offset, support, overlap).
    Items without an id are left out, but findings are counted with those that have none.

    Columns: case_id, evidence_id, kind, source_path, summary and the provenance, null where
    a source has none: name, bytes, figure_id, panel_id, finding_id, label, page, workbook,
    sheet, columns, row_offset, support, overlap."""
    extra = {"name": "string", "bytes": "long", "figure_id": "string", "panel_id": "string", "finding_id": "string", "label": "string", "page": "int", "workbook": "string", "sheet": "string", "columns": "string", "row_offset": "int", "support": "long", "overlap": "long"}

    def part(source: int, rows: DataFrame, seq: Column, kind: str, path: str, summary: Column, own: list[str]) -> DataFrame:
        provenance = [(F.col(c) if c in own else F.lit(None)).cast(t).alias(c) for c, t in extra.items()]
        return rows.select("case_id", F.lit(source).alias("_source"), seq.cast("long").alias("_seq"), F.lit(kind).alias("kind"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("source_path"), summary.alias("summary"), *provenance)

    named = artifacts.withColumn("_place", _chosen({n: k for k, n in enumerate(ARTIFACTS)}, F.col("name"))).filter("_place IS NOT NULL")
    with_id = lambda df, c: df.filter(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    say = lambda text, c: F.concat(F.lit(text), F.coalesce(F.col(c).cast("string"), F.lit("-")))
    first = lambda df: placed(df, ["seq", "finding_id"], ["case_id"], "_seq").filter(F.col("_seq") <= top)
    located = ["finding_id", "workbook", "sheet", "columns", "row_offset", "support", "overlap"]
    parts = [
        part(0, named, F.col("_place"), "output_artifact", "path", say("Audit artifact: ", "name"), ["name", "bytes"]),
        part(1, with_id(figures, "figure_id"), F.col("seq"), "figure", "path", say("Figure ", "figure_id"), ["figure_id", "label", "page"]),
        part(2, with_id(panels, "panel_id"), F.col("seq"), "panel", "path", say("Panel ", "panel_id"), ["panel_id", "figure_id", "label"]),
        part(3, first(relations), F.col("_seq"), "sheet", "workbook", say("Priority finding ", "finding_id"), [c for c in located if c != "row_offset"]),
        part(4, first(pairs), F.col("_seq"), "sheet", "workbook", say("Pair finding ", "finding_id"), located),
    ]
    order = ["_source", "_seq", "name", "figure_id", "panel_id", "finding_id", "source_path"]
    numbered = placed(reduce(DataFrame.unionByName, parts).filter("case_id IS NOT NULL"), order, ["case_id"], "_n")
    prefix = F.element_at(F.array(*map(F.lit, SOURCES)), F.col("_source") + 1)
    return numbered.select("case_id", F.concat(F.lit("EV-"), prefix, F.lit("-"), padded(F.col("_n"), 4)).alias("evidence_id"), F.col("_n").alias("n"), "kind", "source_path", "summary", *extra)


def indexes(evidence: DataFrame) -> DataFrame:
    """(case_id, index, key, evidence_id): the item of each finding, panel and artifact, the
    last one where several have it. One aggregate makes all three indexes."""
    entry = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(name).alias("index"), F.col(c).alias("key")))
    kinds = F.array_compact(F.array(entry("finding", "finding_id"), entry("panel", "panel_id"), entry("artifact", "name")))
    rows = evidence.select("case_id", "n", "evidence_id", F.explode(kinds).alias("e"))
    return rows.groupBy("case_id", "e.index", "e.key").agg(F.max_by("evidence_id", "n").alias("evidence_id"))


def mentions(refs: DataFrame, id_col: str) -> DataFrame:
    """(case_id, id, finding_id): whose references (case_id, ``id_col``, ref as text) name
    which findings. An id is taken whole: FR-00011 doesn't name FR-0001."""
    found = F.explode(F.regexp_extract_all("ref", F.lit(FINDING_ID), F.lit(0)))
    return refs.select("case_id", F.col(id_col).cast("string").alias("id"), found.alias("finding_id")).distinct()


def pattern_key(category: Column, source: Column) -> Column:
    """Pattern of a finding: of its category, else by words of category and source file,
    else the category's own."""
    known = F.coalesce(category, F.lit(""))
    text = F.lower(F.concat_ws(" ", known, F.coalesce(source, F.lit(""))))
    by_word = reduce(lambda acc, kv: acc.when(text.rlike("|".join(kv[1])), kv[0]), list(WORDS.items())[1:], F.when(text.rlike("|".join(WORDS["visual_forensics"])), "visual_forensics"))
    return F.coalesce(_chosen(PATTERNS, known), by_word.when(known != "", F.concat(F.lit("category:"), known)).otherwise("other"))


def shown_rank(category: Column, risk: Column) -> Column:
    """Place of the shown risk in SHOWN: context for categories that are only context,
    medium for findings without a risk, zero for names that aren't known."""
    level = F.when(category.isin(*CONTEXT), "context").otherwise(F.coalesce(risk, F.lit("medium")))
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SHOWN)), level), F.lit(0)) - 1, F.lit(0)).cast("int")


def _score(rank: Column) -> Column:
    """Context counts as little as information does."""
    return F.greatest(rank - 1, F.lit(0))


def _related(members: DataFrame, refs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How many different ids of ``refs`` (case_id, id, finding_id) name a group's members."""
    return members.select(*keys, "finding_id").join(refs, ["case_id", "finding_id"]).groupBy(*keys).agg(F.count_distinct("id").alias(name))


def _with_related(groups: DataFrame, members: DataFrame, keys: list[str], claims: DataFrame, tasks: DataFrame) -> DataFrame:
    for name, refs in (("n_claims", claims), ("n_tasks", tasks)):
        groups = groups.join(_related(members, refs, keys, name), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return groups


def pattern_groups(findings: DataFrame, claims: DataFrame, tasks: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Groups of a case's findings by pattern, and their members in order.

    ``findings`` has case_id, finding_id, category, source, risk_level, workbook, sheet and
    issue_category; ``claims`` and ``tasks`` are ``mentions``. Groups: case_id, pattern_id
    (P-001 and on by the patterns' order, falling size and key), pattern_key, risk_level (the
    highest shown), n_findings, n_sheets, n_workbooks, n_categories, n_claims, n_tasks,
    primary (high or critical with a finding of consistency, the first ``top`` of a case).
    Members: case_id, pattern_key, place (by falling risk, sheet, id), finding_id. A pattern
    may hold any number of findings; none is gathered."""
    key = ["case_id", "pattern_key"]
    keyed = findings.filter("case_id IS NOT NULL").withColumns({"pattern_key": pattern_key(F.col("category"), F.col("source")), "_rank": shown_rank(F.col("category"), F.col("risk_level")), "sheet": F.coalesce("sheet", F.lit(""))})
    members = placed(keyed.select(*key, "_rank", "sheet", "finding_id"), [F.desc(_score(F.col("_rank"))), "sheet", "finding_id"], key).select(*key, "place", "finding_id")
    different = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    groups = keyed.groupBy(*key).agg(F.count("*").alias("n_findings"), different("sheet").alias("n_sheets"), different("workbook").alias("n_workbooks"), different("category").alias("n_categories"), F.max("_rank").alias("_rank"), F.max((F.coalesce("issue_category", F.lit("")) == "consistency").cast("int")).alias("_consistent"))
    order = F.coalesce(_chosen(ORDER, F.col("pattern_key")), F.lit(SINGLE))
    numbered = placed(groups.withColumn("_order", order), ["_order", F.desc("n_findings"), "pattern_key"], ["case_id"], "_n")
    weighty = (F.col("_rank") >= SHOWN.index("high")) & (F.col("_consistent") == 1)
    first = placed(numbered.filter(weighty).select(*key, "_n"), ["_n"], ["case_id"], "_k").filter(F.col("_k") <= top).select(*key, F.lit(True).alias("primary"))
    whole = _with_related(numbered, keyed, key, claims, tasks).join(first, key, "left")
    level = F.element_at(F.array(*map(F.lit, SHOWN)), F.col("_rank") + 1)
    columns = ["n_findings", "n_sheets", "n_workbooks", "n_categories", "n_claims", "n_tasks"]
    return whole.select("case_id", F.concat(F.lit("P-"), padded(F.col("_n"), 3)).alias("pattern_id"), "pattern_key", level.alias("risk_level"), *columns, F.coalesce("primary", F.lit(False)).alias("primary")), members


def evidence_clusters(findings: DataFrame, claims: DataFrame, tasks: DataFrame, top: int = 6, signals: int = 4) -> DataFrame:
    """Clusters EC-001 and on of a case's findings that share workbook (else source) and
    sheet (else category), by falling shown risk, falling size, sheet and workbook.

    Columns: case_id, cluster_id, workbook, sheet, risk_level, n_findings, n_categories,
    n_claims, n_tasks, signals (the ids of the first findings by risk, support and id, joined
    by commas), reported (the first ``top`` of a case). ``findings`` has support as well."""
    key = ["case_id", "workbook", "sheet"]
    either = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit("-"))
    keyed = findings.filter("case_id IS NOT NULL").select("case_id", either("workbook", "source").alias("workbook"), either("sheet", "category").alias("sheet"), "finding_id", "category", shown_rank(F.col("category"), F.col("risk_level")).alias("_rank"), F.coalesce("support", F.lit(0)).alias("support"))
    best = placed(keyed, [F.desc(_score(F.col("_rank"))), F.desc("support"), "finding_id"], key).filter(F.col("place") <= signals)
    some = best.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "finding_id"))), lambda x: x["finding_id"]), ",").alias("signals"))
    groups = keyed.groupBy(*key).agg(F.count("*").alias("n_findings"), F.count_distinct("category").alias("n_categories"), F.max("_rank").alias("_rank")).join(some, key)
    numbered = placed(groups, [F.desc(_score(F.col("_rank"))), F.desc("n_findings"), "sheet", "workbook"], ["case_id"], "_n")
    whole = _with_related(numbered, keyed, key, claims, tasks)
    level = F.element_at(F.array(*map(F.lit, SHOWN)), F.col("_rank") + 1)
    return whole.select("case_id", F.concat(F.lit("EC-"), padded(F.col("_n"), 3)).alias("cluster_id"), "workbook", "sheet", level.alias("risk_level"), "n_findings", "n_categories", "n_claims", "n_tasks", "signals", (F.col("_n") <= top).alias("reported"))
