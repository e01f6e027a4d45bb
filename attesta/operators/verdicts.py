"""Verdicts of sheets brought to single findings, and what a report counts and shows of them.

Verdicts are given on patterns, (category, workbook, sheet), or on finding ids; where a key
has several, the one with the highest ``seq`` counts. Null keys match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.findings import RISKS, latest, risk_rank

PATTERN = ["category", "workbook", "sheet"]
#: Verdicts that are counted as such, priorities, and ranks of issues.
VERDICTS = ("true_positive", "false_positive", "uncertain")
PRIORITIES = ("critical", "high", "medium", "low")
ISSUES = ("completeness", "matching", "consistency")


def _or_default(name: str, default: object) -> Column:
    return F.coalesce(F.col(name), F.lit(default)).alias(name)


def _override(priorities: DataFrame) -> DataFrame:
    """(category, configured) of the priorities that are one of the four."""
    known = priorities.filter(F.col("review_priority").isin(*PRIORITIES))
    return known.groupBy("category").agg(F.max("review_priority").alias("configured"))


def expanded(findings: DataFrame, verdicts: DataFrame, priorities: DataFrame) -> DataFrame:
    """(finding_id, category, workbook, sheet, verdict, confidence, priority, explanation,
    benign_pattern) of every finding, by the verdict on its pattern; without one it is
    uncertain, with confidence 0 and medium priority. A priority that is configured for the
    category, (category, review_priority), goes before the verdict's own."""
    fields = ["verdict", "confidence", "priority", "explanation", "benign_pattern"]
    last = latest(verdicts.select(*PATTERN, "seq", *fields), PATTERN, ["seq"])
    met = findings.select("finding_id", *PATTERN).join(last, PATTERN, "left").join(_override(priorities), "category", "left")
    priority = F.coalesce("configured", "priority", F.lit("medium")).alias("priority")
    return met.select("finding_id", *PATTERN, _or_default("verdict", "uncertain"), _or_default("confidence", 0.0), priority, _or_default("explanation", ""), "benign_pattern")


def _counted() -> list[Column]:
    """How many are of each verdict; any other one is uncertain."""
    known = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("uncertain")
    return [F.count_if(known == v).alias(v) for v in VERDICTS]


def by_category(judged: DataFrame, priorities: DataFrame) -> DataFrame:
    """(category, true_positive, false_positive, uncertain, review_priority)."""
    counts = judged.groupBy("category").agg(*_counted())
    return counts.join(_override(priorities), "category", "left").select("category", *VERDICTS, F.coalesce("configured", F.lit("medium")).alias("review_priority"))


def totals(judged: DataFrame, sheets: DataFrame) -> DataFrame:
    """One row of counts: sheets and failed ones of ``sheets`` (workbook, sheet, status),
    findings, and verdicts."""
    found = judged.agg(F.count("*").alias("total_findings"), *_counted())
    judging = sheets.agg(F.count("*").alias("total_sheets"), F.count_if(F.col("status") == "failed").alias("failed_sheets"))
    return judging.crossJoin(found)  # one row each


def report_split(findings: DataFrame, verdicts: DataFrame, certainty: DataFrame) -> DataFrame:
    """Findings with the verdict on their id (verdict, confidence, explanation), the certainty
    on their id (fact, inference, suggestion), and whether they stay in the report: all but
    false positives do. Findings without the one or the other have nulls there."""
    say = ["verdict", "confidence", "explanation"]
    layers = ["fact", "inference", "suggestion"]
    judged = latest(verdicts.select("finding_id", "seq", _or_default("verdict", "uncertain"), _or_default("confidence", 0.0), _or_default("explanation", "")), ["finding_id"], ["seq"])
    layered = latest(certainty.select("finding_id", "seq", *[_or_default(c, "") for c in layers]), ["finding_id"], ["seq"])
    met = findings.drop(*say, *layers, "active").join(judged.select("finding_id", *say), "finding_id", "left").join(layered.select("finding_id", *layers), "finding_id", "left")
    return met.withColumn("active", F.coalesce(F.col("verdict") != "false_positive", F.lit(True)))


def issue_rank(issue: Column) -> Column:
    """consistency 3, matching 2, completeness 1, anything else 0, in any case."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ISSUES)), F.lower(issue)), F.lit(0)).cast("int")


def top_findings(findings: DataFrame, top: int = 5) -> DataFrame:
    """(place, finding_id, issue_category, risk_level): the ``top`` findings of medium risk
    or more, by kind of issue and risk; ties by id. A report, so it is limited."""
    ranked = findings.select("finding_id", "issue_category", "risk_level", issue_rank(F.col("issue_category")).alias("i"), risk_rank(F.lower("risk_level")).alias("r")).filter(F.col("r") >= RISKS.index("medium"))
    best = ranked.orderBy(F.desc("i"), F.desc("r"), "finding_id").limit(top)
    place = F.row_number().over(Window.orderBy(F.desc("i"), F.desc("r"), "finding_id"))
    return best.select(place.alias("place"), "finding_id", "issue_category", "risk_level")


def task_details(clusters: DataFrame, refs: int = 12, top: int = 20) -> DataFrame:
    """(task_id, category, workbook, sheet, priority, n_clusters, n_findings, signatures,
    representatives): the ``top`` review tasks with up to ``refs`` signatures and finding ids,
    those of the riskiest and largest clusters first. Only ``refs`` clusters of a task are
    held at once, as each has at least one of either."""
    w = Window.partitionBy(*PATTERN).orderBy(F.desc("rank"), F.desc("size"), "signature", "row_offset")
    tasks = clusters.groupBy(*PATTERN).agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_findings"), F.max("rank").alias("rank"))
    order = [F.desc("rank"), F.desc("n_findings"), *PATTERN]
    best = tasks.orderBy(*order).limit(top).withColumn("n", F.row_number().over(Window.orderBy(*order)))
    first = clusters.join(F.broadcast(best.select(*PATTERN)), PATTERN, "left_semi").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= refs)
    held = first.groupBy(*PATTERN).agg(F.array_sort(F.collect_list(F.struct("place", "signature", F.split("representatives", ",").alias("ids")))).alias("held"))
    some = lambda xs: F.array_join(F.slice(F.array_distinct(xs), 1, refs), ",")
    level = F.element_at(F.array(*map(F.lit, RISKS)), F.col("rank") + 1)
    return best.join(held, PATTERN).select(
        F.format_string("PFRT-%03d", "n").alias("task_id"), *PATTERN, level.alias("priority"), "n_clusters", "n_findings",
        some(F.transform("held", lambda x: x["signature"])).alias("signatures"), some(F.flatten(F.transform("held", lambda x: x["ids"]))).alias("representatives"),
    )
