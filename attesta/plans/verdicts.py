"""Verdicts over the findings of the supplier sheets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import verdicts as ops
from attesta.plans import sheets
from attesta.plans.findings import _ALL, _CLUSTERS, fixed_relationships, relation_findings

#: Planted: the priorities that are configured for categories, one of them unknown.
_CONFIGURED = [("fixed_ratio", "critical"), ("fixed_difference", "urgent"), (None, "low")]
_GIVEN = ("true_positive", "false_positive", "maybe", None)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of verdicts on two categories of every third supplier."""
    s = sheets.read(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0")
    rows = s.select("s_suppkey", F.explode(F.array(F.lit("fixed_ratio"), F.lit("fixed_difference"))).alias("category")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    key = F.col("s_suppkey")
    given = F.element_at(F.array(*map(F.lit, _GIVEN)), ((key + F.col("seq")) % 4 + 1).cast("int"))
    return rows.select(
        "category", F.lit("lineitem").alias("workbook"), key.cast("string").alias("sheet"), "seq", given.alias("verdict"), (F.col("seq") / 2).alias("confidence"),
        F.when(key % 2 == 0, "high").alias("priority"), F.concat(F.lit("round "), F.col("seq").cast("string")).alias("explanation"), F.lit(None).cast("string").alias("benign_pattern"),
    )


def _priorities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CONFIGURED, "category string, review_priority string")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.expanded(relation_findings(spark, sf_dir), _verdicts(spark, sf_dir), _priorities(spark))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("s_acctbal") < 0, "failed").otherwise("ok")
    rows = sheets.read(spark, sf_dir, "supplier").select(F.lit("lineitem").alias("workbook"), F.col("s_suppkey").cast("string").alias("sheet"), status.alias("status"))
    return ops.totals(_judged(spark, sf_dir), rows)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and certainty by id, made of every second and third number of the ids."""
    f = ops.latest(relation_findings(spark, sf_dir), ["finding_id"], ["rank"])
    n = F.substring_index("finding_id", "-", -1).cast("int")
    twice = F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")
    given = F.when((F.col("seq") == 2) & (n % 4 == 0), "false_positive").when(F.col("seq") == 1, "false_positive")
    verdicts = f.filter(n % 2 == 0).select("finding_id", twice).select("*", given.alias("verdict"), F.lit(None).cast("double").alias("confidence"), F.lit("x").alias("explanation"))
    layers = f.filter(n % 3 == 0).select("finding_id", twice, "category").select("finding_id", "seq", F.concat_ws(":", "category", "seq").alias("fact"), F.lit(None).cast("string").alias("inference"), F.lit("look").alias("suggestion"))
    return ops.report_split(f, verdicts, layers).select("finding_id", "category", "verdict", "confidence", "explanation", "fact", "inference", "suggestion", "active")


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.when(F.col("category") == "fixed_ratio", "Matching").when(F.col("category") == "fixed_difference", "completeness").when(F.col("sheet").cast("int") % 5 == 0, "consistency")
    return ops.top_findings(relation_findings(spark, sf_dir).withColumn("issue_category", issue))


QUERIES = {
    "verdict_expansion": _judged,
    "verdict_categories": lambda s, d: ops.by_category(_judged(s, d), _priorities(s)),
    "verdict_totals": _totals,
    "report_split": _split,
    "top_findings": _top,
    "review_task_details": lambda s, d: ops.task_details(fixed_relationships(s, d)),
}

_GIVEN_SQL = """CASE (s_suppkey + 2) % 4 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'maybe' END"""
_JUDGED = f"""{_ALL}, j AS (
        SELECT finding_id, category, workbook, sheet, coalesce({_GIVEN_SQL}, 'uncertain') AS verdict, CASE WHEN s_suppkey IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence,
               CASE WHEN category = 'fixed_ratio' THEN 'critical' WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'medium' END AS priority,
               CASE WHEN s_suppkey IS NULL THEN '' ELSE 'round 2' END AS explanation, NULL AS benign_pattern
        FROM f LEFT JOIN supplier ON category IN ('fixed_ratio', 'fixed_difference') AND s_suppkey % 3 = 0 AND sheet = s_suppkey::VARCHAR)"""
_COUNTS = "count(*) FILTER (verdict = 'true_positive') AS true_positive, count(*) FILTER (verdict = 'false_positive') AS false_positive, count(*) FILTER (verdict NOT IN ('true_positive', 'false_positive')) AS uncertain"

SQL = {
    "verdict_expansion": f"WITH {_JUDGED} SELECT * FROM j",
    "verdict_categories": f"WITH {_JUDGED} SELECT category, {_COUNTS}, CASE WHEN category = 'fixed_ratio' THEN 'critical' ELSE 'medium' END AS review_priority FROM j GROUP BY category",
    "verdict_totals": f"WITH {_JUDGED} SELECT (SELECT count(*) FROM supplier) AS total_sheets, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS failed_sheets, count(*) AS total_findings, {_COUNTS} FROM j",
    "report_split": f"""WITH {_ALL}, n AS (SELECT finding_id, category, CAST(split_part(finding_id, '-', 2) AS INTEGER) AS n FROM f)
        SELECT finding_id, category, CASE WHEN n % 4 = 0 THEN 'false_positive' WHEN n % 2 = 0 THEN 'uncertain' END AS verdict, CASE WHEN n % 2 = 0 THEN 0.0::DOUBLE END AS confidence, CASE WHEN n % 2 = 0 THEN 'x' END AS explanation,
               CASE WHEN n % 3 = 0 THEN category || ':2' END AS fact, CASE WHEN n % 3 = 0 THEN '' END AS inference, CASE WHEN n % 3 = 0 THEN 'look' END AS suggestion, n % 4 <> 0 AS active FROM n""",
    "top_findings": f"""WITH {_ALL}, i AS (SELECT *, CASE WHEN category = 'fixed_ratio' THEN 'Matching' WHEN category = 'fixed_difference' THEN 'completeness' WHEN sheet::INTEGER % 5 = 0 THEN 'consistency' END AS issue_category FROM f WHERE rank >= 2),
        o AS (SELECT row_number() OVER (ORDER BY CASE issue_category WHEN 'Matching' THEN 2 WHEN 'completeness' THEN 1 WHEN 'consistency' THEN 3 ELSE 0 END DESC, rank DESC, finding_id)::INTEGER AS place, finding_id, issue_category, risk_level FROM i)
        SELECT * FROM o WHERE place <= 5""",
    "review_task_details": f"""WITH {_ALL}, {_CLUSTERS},
        t AS (SELECT category, workbook, sheet, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_findings, max(rank) AS rank FROM c GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (ORDER BY rank DESC, n_findings DESC, category, workbook, sheet) AS n FROM t),
        k AS (SELECT *, row_number() OVER (PARTITION BY category, workbook, sheet ORDER BY rank DESC, size DESC, signature, row_offset) AS place FROM c),
        s AS (SELECT category, workbook, sheet, string_agg(signature, ',' ORDER BY place) AS signatures, array_to_string(string_split(string_agg(representatives, ',' ORDER BY place), ',')[:12], ',') AS representatives FROM k WHERE place <= 12 GROUP BY ALL)
        SELECT 'PFRT-' || lpad(n::VARCHAR, 3, '0') AS task_id, category, workbook, sheet, ['info', 'low', 'medium', 'high', 'critical'][rank + 1] AS priority, n_clusters, n_findings, signatures, representatives
        FROM o JOIN s USING (category, workbook, sheet) WHERE n <= 20""",
}
