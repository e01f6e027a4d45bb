"""From detectors to findings, clusters, tasks and grades on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import findings as ops
from attesta.operators import pairs
from attesta.operators.similarity import checkpointed
from attesta.plans import blocks, relations, sheets
from attesta.plans.relations import SQL as RELATIONS


def _columns():
    return F.concat_ws("|", F.col("left").cast("string"), F.col("right").cast("string"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    with sheets.kept_supplier(spark, sf_dir) as (cells, rows):
        return pairs.relations(cells, rows=rows, **sheets.known(spark, sf_dir))


def relation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate columns, fixed differences and fixed ratios of the supplier sheets."""
    found = _relations(spark, sf_dir).withColumn("relationship", F.col("value"))
    return ops.numbered([ops.unified(found, _columns())])


def _part(name: str) -> str:
    return f"SELECT workbook, sheet, category, risk_level, concat_ws('|', CAST(\"left\" AS VARCHAR), CAST(\"right\" AS VARCHAR)) AS columns, CAST(NULL AS INTEGER) AS row_offset, CAST(value AS VARCHAR) AS relationship, CAST(NULL AS INTEGER) AS width, support, overlap, support_rate, artifact_likelihood FROM ({RELATIONS[name]})"


def _numbered_sql(parts: list[str]) -> str:
    """f: the union of ``parts`` with ranks and ids."""
    prefix = "CASE category " + " ".join(f"WHEN '{c}' THEN '{p}'" for c, p in ops.PREFIX.items()) + f" ELSE '{ops.OTHER}' END"
    return f"""u AS ({" UNION ALL ".join(parts)}),
    ranked AS (SELECT *, CAST(CASE risk_level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS INTEGER) AS rank FROM u),
    f AS (
        SELECT *, {prefix} || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS finding_id
        FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank DESC, workbook, sheet, columns, row_offset NULLS FIRST, relationship NULLS FIRST, support NULLS FIRST) AS n FROM ranked))"""


_ALL = _numbered_sql([*map(_part, ("duplicate_columns", "fixed_difference", "fixed_ratio"))])
_FIELDS = "workbook, sheet, category, risk_level, columns, row_offset, relationship, width, support, overlap, support_rate, artifact_likelihood, rank, finding_id"
_BY_RELATIONSHIP = ", ".join(f"'{c}'" for c in ops.BY_RELATIONSHIP)
_CLUSTERS = f"""p AS (
        SELECT *, CASE WHEN category IN ({_BY_RELATIONSHIP}) THEN 'offset=' || coalesce(CAST(row_offset AS VARCHAR), '-') || ';relationship=' || coalesce(relationship, '-')
                       WHEN category = 'duplicate_row_vector' THEN 'width=' || coalesce(CAST(width AS VARCHAR), '-') ELSE 'offset=' || coalesce(CAST(row_offset AS VARCHAR), '-') END AS signature
        FROM f WHERE rank >= 2 AND coalesce(artifact_likelihood, '') <> 'high'),
    placed AS (SELECT *, row_number() OVER (PARTITION BY category, workbook, sheet, row_offset, signature ORDER BY rank DESC, support DESC NULLS LAST, finding_id) AS place FROM p),
    c AS (
        SELECT category, workbook, sheet, row_offset, signature, count(*) AS size, CAST(sum(support) AS BIGINT) AS support, max(support_rate) AS max_rate, max(rank) AS rank, string_agg(finding_id, ',' ORDER BY place) FILTER (place <= 8) AS representatives
        FROM placed GROUP BY category, workbook, sheet, row_offset, signature)"""


_PAIR = "concat_ws('|', CAST(l AS STRING), CAST(r AS STRING))"
#: Every detector as a part of all findings: query, whether it names column pairs, and the
#: common fields as expressions that both dialects read; ones left out are null.
DETECTORS = [
    ("duplicate_columns", True, {"columns": _PAIR, "relationship": "CAST(value AS STRING)", "support": "support", "overlap": "overlap", "support_rate": "support_rate", "artifact_likelihood": "artifact_likelihood"}),
    ("fixed_difference", True, {"columns": _PAIR, "relationship": "CAST(value AS STRING)", "support": "support", "overlap": "overlap", "support_rate": "support_rate", "artifact_likelihood": "artifact_likelihood"}),
    ("fixed_ratio", True, {"columns": _PAIR, "relationship": "CAST(value AS STRING)", "support": "support", "overlap": "overlap", "support_rate": "support_rate", "artifact_likelihood": "artifact_likelihood"}),
    ("pair_spread", True, {"columns": _PAIR, "overlap": "overlap", "artifact_likelihood": "artifact_likelihood"}),
    ("small_n_fixed", True, {"columns": _PAIR, "relationship": "CAST(value AS STRING)", "support": "n", "overlap": "n"}),
    ("strict_linear", True, {"columns": _PAIR, "relationship": "concat_ws('|', CAST(slope AS STRING), CAST(intercept AS STRING))", "support": "n", "overlap": "n", "artifact_likelihood": "artifact_likelihood"}),
    ("copy_paste_modify", True, {"columns": _PAIR, "relationship": "CAST(delta AS STRING)", "support": "support", "overlap": "overlap", "support_rate": "support_rate", "artifact_likelihood": "artifact_likelihood"}),
    ("shifted_paste", True, {"columns": _PAIR, "row_offset": "lag", "relationship": "CAST(delta AS STRING)", "support": "support", "overlap": "overlap", "support_rate": "support_rate", "artifact_likelihood": "artifact_likelihood"}),
    ("decimal_tail_shifted", True, {"columns": _PAIR, "row_offset": "shift", "relationship": "CAST(token AS STRING)", "support": "support", "overlap": "overlap", "support_rate": "support_rate", "artifact_likelihood": "artifact_likelihood"}),
    ("binary_arithmetic", False, {"columns": "concat_ws('|', CAST(c1 AS STRING), CAST(c2 AS STRING), CAST(c3 AS STRING))", "relationship": "op", "support": "support", "overlap": "overlap", "support_rate": "support_rate", "artifact_likelihood": "artifact_likelihood"}),
    ("row_offset_reuse", False, {"columns": "columns", "row_offset": "row_offset", "relationship": "CAST(ratio AS STRING)", "support": "support", "overlap": "overlap", "support_rate": "support_rate"}),
    ("paired_ratio_reuse", True, {"columns": _PAIR, "row_offset": "row_offset", "support": "support", "overlap": "overlap", "artifact_likelihood": "artifact_likelihood"}),
    ("rounding_bias", False, {"columns": "CAST(col AS STRING)", "row_offset": "row_offset", "risk_level": "'high'", "support": "exact", "overlap": "n"}),
    ("long_format_reuse", False, {"columns": "'-'", "row_offset": "row_offset", "risk_level": "CASE WHEN support >= 10 THEN 'high' ELSE 'medium' END", "support": "support", "overlap": "overlap"}),
    ("long_format_enrichment", False, {"columns": "'-'", "relationship": "CAST(ratio AS STRING)", "support": "support", "overlap": "overlap"}),
    ("internal_sequence", False, {"columns": "CAST(col AS STRING)", "relationship": "concat_ws('|', relation, CAST(start AS STRING))", "support": "n", "artifact_likelihood": "artifact_likelihood"}),
    ("cross_block_diff", False, {"columns": "concat_ws('|', CAST(col AS STRING), CAST(block_x AS STRING), CAST(block_y AS STRING))", "support": "n_rows", "overlap": "n_rows"}),
    ("duplicate_rows", False, {"columns": "CAST(first_row AS STRING)", "width": "width", "support": "n", "overlap": "n", "artifact_likelihood": "artifact_likelihood"}),
    ("repeated_values", False, {"columns": "'-'", "relationship": "CAST(value AS STRING)", "support": "n"}),
    ("tail_reuse", False, {"columns": "'-'", "relationship": "CAST(tail AS STRING)", "support": "n"}),
    ("cross_sheet_tails", False, {"sheet": "sheet_x", "columns": "concat_ws('|', CAST(row_x AS STRING), sheet_y, CAST(row_y AS STRING))", "support": "support"}),
]
_KINDS_OF_FIELDS = {"workbook": "STRING", "sheet": "STRING", "category": "STRING", "risk_level": "STRING", "columns": "STRING", "row_offset": "INT", "relationship": "STRING", "width": "INT", "support": "BIGINT", "overlap": "BIGINT", "support_rate": "DOUBLE", "artifact_likelihood": "STRING"}


def _fields(exprs: dict[str, str]) -> list[str]:
    own = {"workbook": "workbook", "sheet": "sheet", "category": "category", "risk_level": "risk_level"} | exprs
    return [f"CAST({own.get(name, 'NULL')} AS {kind}) AS {name}" for name, kind in _KINDS_OF_FIELDS.items()]


def every_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all detectors over all their sheets, numbered by category."""
    run = {**relations.QUERIES, **blocks.QUERIES}
    shared = ("duplicate_columns", "fixed_difference", "fixed_ratio")  # three categories of one pass over the pairs
    found = [(_relations(spark, sf_dir), DETECTORS[0][2])]
    found += [(run[name](spark, sf_dir), exprs) for name, _, exprs in DETECTORS if name not in shared]
    parts = [df.withColumnsRenamed({"left": "l", "right": "r"}).selectExpr(*_fields(exprs)) for df, exprs in found]
    # One job per detector: what it broadcasts and sorts is given back before the next one.
    return ops.numbered([checkpointed(part) for part in parts])


def _detector_sql(name: str, pairs_named: bool, exprs: dict[str, str]) -> str:
    source = {**relations.SQL, **blocks.SQL}[name]
    rows = f'SELECT *, "left" AS l, "right" AS r FROM ({source})' if pairs_named else source
    return f"SELECT {', '.join(_fields(exprs))} FROM ({rows})"


def fixed_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: detectors, priority filter, clusters."""
    return ops.clusters(ops.priority(relation_findings(spark, sf_dir)))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of verdicts on the sheets of some suppliers; the later one counts."""
    s = sheets.read(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0")
    rounds = s.select(F.lit("fixed_ratio").alias("category"), F.lit("lineitem").alias("workbook"), F.col("s_suppkey").cast("string").alias("sheet"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "s_suppkey")
    verdict = F.when((F.col("seq") == 2) & (F.col("s_suppkey") % 2 == 0), "false_positive").otherwise("confirmed")
    return rounds.select("category", "workbook", "sheet", "seq", verdict.alias("verdict"))


_EVERY = _numbered_sql([_detector_sql(*d) for d in DETECTORS])
_ISSUES = ("consistency", "completeness", "other")
_KINDS = ("fixed_ratio", "data_leakage", "paperfraud.methodology_review", "duplicate_row_vector")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases: orders are steps, and findings as well."""
    orders = sheets.read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    step = F.element_at(F.array(*map(F.lit, ("discover", "parse", "source_data_scan", "report", "visual"))), (key % 5 + 1).cast("int"))
    status = F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400_000), "failed").otherwise("done")
    runs = orders.select(F.col("o_custkey").alias("case_id"), step.alias("step"), status.alias("status"))
    issue = F.element_at(F.array(*map(F.lit, _ISSUES)), (key % 3 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.floor(key / 3) % 4 + 1).cast("int"))
    risk = F.when(F.col("o_totalprice") > 420_000, "high").when(F.col("o_totalprice") > 300_000, "medium").otherwise("low")
    found = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("case_id"), risk.alias("risk_level"), kind.alias("category"), issue.alias("issue_category"))
    return ops.grade(runs, found, "partial")


_GRADE_SQL = f"""WITH r AS (
        SELECT o_custkey AS case_id, ['discover', 'parse', 'source_data_scan', 'report', 'visual'][o_orderkey % 5 + 1] AS step, o_orderstatus = 'F' AND o_totalprice > 400000 AS failed FROM orders),
    s AS (SELECT case_id, bool_or(failed AND step = 'discover') AS broken, bool_or(failed AND step LIKE 'source_data%') AS partly FROM r GROUP BY ALL),
    g AS (SELECT o_custkey AS case_id, CASE WHEN o_totalprice > 420000 THEN 3 WHEN o_totalprice > 300000 THEN 2 ELSE 1 END AS rank, {list(_KINDS)}[o_orderkey // 3 % 4 + 1] AS kind, {list(_ISSUES)}[o_orderkey % 3 + 1] AS issue FROM orders WHERE o_orderpriority = '1-URGENT'),
    y AS (SELECT *, CASE WHEN kind IN ('duplicate_row_vector', 'paperfraud.methodology_review') THEN 3 WHEN rank = 3 THEN 1 WHEN rank = 2 THEN 2 ELSE 3 END AS layer FROM g),
    k AS (SELECT case_id, max(rank) FILTER (issue = 'consistency') AS top, bool_or((issue = 'completeness' AND rank = 3) OR (layer = 1 AND kind = 'data_leakage')) AS method, bool_or(kind = 'paperfraud.methodology_review') AS reviewed, bool_or(layer < 3) AS weighty FROM y GROUP BY ALL),
    d AS (
        SELECT case_id, CASE WHEN broken THEN 'fail' WHEN partly THEN 'warning' ELSE 'pass' END AS reproducibility, CASE WHEN top = 3 THEN 'fail' WHEN top = 2 THEN 'warning' WHEN top = 1 THEN 'pass_with_notes' ELSE 'pass' END AS fidelity,
               CASE WHEN method THEN 'warning' ELSE 'pass' END AS methodology, CASE WHEN reviewed THEN 'warning' WHEN NOT weighty THEN 'pass_with_notes' ELSE 'pass' END AS interpretation FROM s LEFT JOIN k USING (case_id))
    SELECT *, CASE WHEN reproducibility = 'fail' THEN 'D' WHEN fidelity = 'fail' THEN 'C' ELSE 'B' END AS grade FROM d"""

QUERIES = {
    "fixed_relationships": fixed_relationships,
    "findings": relation_findings,
    "every_finding": every_finding,
    "finding_clusters": lambda s, d: ops.clusters(ops.priority(every_finding(s, d))),
    "review_tasks": lambda s, d: ops.review_tasks(fixed_relationships(s, d)),
    "finding_layers": lambda s, d: ops.layers(relation_findings(s, d)),
    "risk_summary": lambda s, d: ops.risk_summary(relation_findings(s, d)),
    "verdict_split": lambda s, d: ops.expand_verdicts(relation_findings(s, d), _verdicts(s, d)).groupBy("category", "active", "verdict").agg(F.count("*").alias("n")),
    "similar_findings": lambda s, d: ops.group_similar(relation_findings(s, d)).groupBy("suppressed_by").agg(F.count("*").alias("n")),
    "grades": grades,
}

SQL = {
    "fixed_relationships": f"WITH {_ALL}, {_CLUSTERS} SELECT * FROM c",
    "findings": f"WITH {_ALL} SELECT {_FIELDS} FROM f",
    "every_finding": f"WITH {_EVERY} SELECT {_FIELDS} FROM f",
    "finding_clusters": f"WITH {_EVERY}, {_CLUSTERS} SELECT * FROM c",
    "review_tasks": f"WITH {_ALL}, {_CLUSTERS} SELECT category, workbook, sheet, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_findings, max(rank) AS rank FROM c GROUP BY category, workbook, sheet ORDER BY rank DESC, n_findings DESC, category, workbook, sheet LIMIT 20",
    "finding_layers": f"WITH {_ALL} SELECT CASE WHEN rank >= 3 THEN 1 WHEN rank = 2 THEN 2 ELSE 3 END AS layer, category, count(*) AS n FROM f GROUP BY ALL",
    "risk_summary": f"WITH {_ALL} SELECT workbook, count(*) FILTER (rank = 0) AS n_info, count(*) FILTER (rank = 1) AS n_low, count(*) FILTER (rank = 2) AS n_medium, count(*) FILTER (rank = 3) AS n_high, count(*) FILTER (rank = 4) AS n_critical, ['info', 'low', 'medium', 'high', 'critical'][max(rank) + 1] AS overall FROM f GROUP BY workbook",
    "verdict_split": f"""WITH {_ALL}, v AS (SELECT 'fixed_ratio' AS category, CAST(s_suppkey AS VARCHAR) AS sheet, CASE WHEN s_suppkey % 2 = 0 THEN 'false_positive' ELSE 'confirmed' END AS verdict FROM supplier WHERE s_suppkey % 3 = 0)
        SELECT f.category, coalesce(verdict <> 'false_positive', true) AS active, verdict, count(*) AS n FROM f LEFT JOIN v ON v.category = f.category AND v.sheet = f.sheet GROUP BY ALL""",
    "similar_findings": f"WITH {_ALL}, g AS (SELECT CASE WHEN count(*) OVER (PARTITION BY category, workbook, sheet) >= 2 THEN 'G:' || category || ':' || workbook || ':' || sheet END AS suppressed_by FROM f) SELECT suppressed_by, count(*) AS n FROM g GROUP BY ALL",
    "grades": _GRADE_SQL,
}
