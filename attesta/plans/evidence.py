"""Evidence and report groups on the driver's tables, with their SQL: orders are findings
of forty cases, customers and suppliers the claims and tasks that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import evidence as ops
from attesta.operators.findings import OTHER, PREFIX
from attesta.plans.sheets import read

CASES = 40
_CATEGORIES = [*PREFIX, "image_overlap", "benford_digits", "runtime_failure", "unheard_of", ""]
_PREFIXES = [*PREFIX.values(), *[OTHER] * 5]
_LEVELS = ["low", "medium", "high", "critical", "info"]
_NAMES = [*ops.ARTIFACTS, "notes.txt", "draft.json"]


def _nth(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _id(k: Column) -> Column:
    return F.concat(_nth(_PREFIXES, k), F.lit("-"), F.lpad(k.cast("string"), 8, "0"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    return read(spark, sf_dir, "orders").select(
        (k % CASES).alias("case_id"), k.alias("seq"), _id(k).alias("finding_id"), _nth(_CATEGORIES, k).alias("category"), F.when(k % 11 == 0, "visual_findings.json").otherwise("").alias("source"), F.when(k % 7 != 0, _nth(_LEVELS, F.floor(k / 3))).alias("risk_level"),
        F.when(k % 9 != 0, F.concat(F.lit("w"), text(F.floor(k / CASES) % 3))).alias("workbook"), F.when(k % 5 != 0, F.concat(F.lit("s"), text(F.floor(k / CASES) % 4))).alias("sheet"), F.when(k % 3 == 0, "consistency").alias("issue_category"), (k % 100).alias("support"), (k % 30).cast("int").alias("row_offset"),
    )


def refs(spark: SparkSession, sf_dir: str, table: str, key: str, step: int) -> DataFrame:
    """Rows that name two findings of one case."""
    k = F.col(key) * step
    rows = read(spark, sf_dir, table).select((k % CASES).alias("case_id"), F.col(key), F.concat(F.lit("see "), _id(k), F.lit(" and ("), _id(k + CASES), F.lit(")")).alias("ref"))
    return ops.mentions(rows, key)


def _report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return found(spark, sf_dir), refs(spark, sf_dir, "customer", "c_custkey", 4), refs(spark, sf_dir, "supplier", "s_suppkey", 3)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, e, f = read(spark, sf_dir, "part"), read(spark, sf_dir, "embeddings"), found(spark, sf_dir)
    k, v = F.col("p_partkey"), F.col("vec_id")
    name = _nth(_NAMES, F.floor(k / CASES))
    artifacts = part.select((k % CASES).alias("case_id"), name.alias("name"), F.concat(F.lit("w/"), k.cast("string"), F.lit("/"), name).alias("path"), F.col("p_size").alias("bytes"))
    label = F.concat(F.lit("Fig. "), (v % 9).cast("string"))
    figures = e.select((v % CASES).alias("case_id"), v.alias("seq"), F.when(v % 7 != 0, F.concat(F.lit("F"), v.cast("string"))).alias("figure_id"), F.concat(F.lit("f/"), v.cast("string")).alias("path"), label.alias("label"), (v % 20).alias("page"))
    panels = e.select((v % CASES).alias("case_id"), v.alias("seq"), F.concat(F.lit("A"), (v % (7 * CASES)).cast("string")).alias("panel_id"), F.concat(F.lit("F"), v.cast("string")).alias("figure_id"), F.when(v % 2 == 0, F.concat(F.lit("p/"), v.cast("string"))).alias("path"), label.alias("label"))
    rows = f.withColumns({"columns": F.lit(None).cast("string"), "overlap": F.col("support") + 1})
    return ops.items(artifacts, figures, panels, rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"))


_FOUND_SQL = f"""f AS (
        SELECT o_orderkey % {CASES} AS case_id, o_orderkey AS seq, {_PREFIXES}[o_orderkey % {len(_PREFIXES)} + 1] || '-' || lpad(o_orderkey::VARCHAR, 8, '0') AS finding_id, {_CATEGORIES}[o_orderkey % {len(_CATEGORIES)} + 1] AS category, o_orderkey % 11 = 0 AS drawn,
               CASE WHEN o_orderkey % 7 <> 0 THEN {_LEVELS}[o_orderkey // 3 % 5 + 1] END AS risk_level, CASE WHEN o_orderkey % 9 <> 0 THEN 'w' || (o_orderkey // {CASES} % 3) END AS workbook, CASE WHEN o_orderkey % 5 <> 0 THEN 's' || (o_orderkey // {CASES} % 4) END AS sheet,
               o_orderkey % 3 = 0 AS consistent, o_orderkey % 100 AS support, o_orderkey % 30 AS row_offset FROM orders),
    g AS (
        SELECT *, CASE WHEN category IN {tuple(ops.CONTEXT * 2)} THEN 1 ELSE list_position({list(ops.SHOWN)}, coalesce(risk_level, 'medium')) - 1 END AS rank,
               CASE WHEN map_contains(p, category) THEN p[category] WHEN drawn OR category LIKE '%image%' THEN 'visual_forensics' WHEN category LIKE '%benford%' THEN 'numeric_forensics' WHEN category LIKE '%runtime%' THEN 'execution_evidence' WHEN category <> '' THEN 'category:' || category ELSE 'other' END AS pattern_key
        FROM f, (SELECT MAP {{{", ".join(f"'{c}': '{k}'" for c, k in ops.PATTERNS.items())}}} AS p)),
    named AS (SELECT 'claim' AS kind, c_custkey AS id, unnest([c_custkey * 4, c_custkey * 4 + {CASES}]) AS seq FROM customer UNION ALL SELECT 'task', s_suppkey, unnest([s_suppkey * 3, s_suppkey * 3 + {CASES}]) FROM supplier)"""
_GROUPS_SQL = f"""WITH {_FOUND_SQL},
    c AS (SELECT case_id, pattern_key, count(DISTINCT id) FILTER (kind = 'claim') AS n_claims, count(DISTINCT id) FILTER (kind = 'task') AS n_tasks FROM g JOIN named USING (seq) GROUP BY ALL),
    a AS (SELECT case_id, pattern_key, count(*) AS n_findings, count(DISTINCT sheet) AS n_sheets, count(DISTINCT workbook) AS n_workbooks, count(DISTINCT nullif(category, '')) AS n_categories, max(rank) AS rank, bool_or(consistent) AND max(rank) >= 4 AS weighty FROM g GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(o[pattern_key], {ops.SINGLE}), n_findings DESC, pattern_key) AS n FROM a, (SELECT MAP {{{", ".join(f"'{k}': {v}" for k, v in ops.ORDER.items())}}} AS o)),
    k AS (SELECT *, count(*) FILTER (weighty) OVER (PARTITION BY case_id ORDER BY n) AS k FROM n)
    SELECT case_id, 'P-' || lpad(n::VARCHAR, 3, '0') AS pattern_id, pattern_key, {list(ops.SHOWN)}[rank + 1] AS risk_level, n_findings, n_sheets, n_workbooks, n_categories, coalesce(n_claims, 0) AS n_claims, coalesce(n_tasks, 0) AS n_tasks, weighty AND k <= 20 AS primary
    FROM k LEFT JOIN c USING (case_id, pattern_key)"""
_MEMBERS_SQL = f"WITH {_FOUND_SQL} SELECT case_id, pattern_key, row_number() OVER (PARTITION BY case_id, pattern_key ORDER BY greatest(rank - 1, 0) DESC, coalesce(sheet, ''), finding_id) AS place, finding_id FROM g"
_CLUSTERS_SQL = f"""WITH {_FOUND_SQL},
    k AS (SELECT *  REPLACE (coalesce(workbook, CASE WHEN drawn THEN 'visual_findings.json' ELSE '-' END) AS workbook, coalesce(sheet, nullif(category, ''), '-') AS sheet) FROM g),
    p AS (SELECT *, row_number() OVER (PARTITION BY case_id, workbook, sheet ORDER BY greatest(rank - 1, 0) DESC, support DESC, finding_id) AS place FROM k),
    a AS (SELECT case_id, workbook, sheet, count(*) AS n_findings, count(DISTINCT category) AS n_categories, max(rank) AS rank, string_agg(finding_id, ',' ORDER BY place) FILTER (place <= 4) AS signals FROM p GROUP BY ALL),
    c AS (SELECT case_id, workbook, sheet, count(DISTINCT id) FILTER (kind = 'claim') AS n_claims, count(DISTINCT id) FILTER (kind = 'task') AS n_tasks FROM k JOIN named USING (seq) GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY greatest(rank - 1, 0) DESC, n_findings DESC, sheet, workbook) AS n FROM a)
    SELECT case_id, 'EC-' || lpad(n::VARCHAR, 3, '0') AS cluster_id, workbook, sheet, {list(ops.SHOWN)}[rank + 1] AS risk_level, n_findings, n_categories, coalesce(n_claims, 0) AS n_claims, coalesce(n_tasks, 0) AS n_tasks, signals, n <= 6 AS reported
    FROM n LEFT JOIN c USING (case_id, workbook, sheet)"""
_ITEMS_SQL = f"""{_FOUND_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id, seq % 2 ORDER BY seq) AS k FROM f),
    arts AS (SELECT p_partkey % {CASES} AS case_id, {_NAMES}[p_partkey // {CASES} % {len(_NAMES)} + 1] AS name, p_partkey, p_size FROM part),
    u AS (
        SELECT case_id, 0 AS source, list_position({list(ops.ARTIFACTS)}, name)::BIGINT AS k, 'output_artifact' AS kind, 'w/' || p_partkey || '/' || name AS source_path, 'Audit artifact: ' || name AS summary, name, p_size::BIGINT AS bytes, NULL::VARCHAR AS figure_id, NULL::VARCHAR AS panel_id, NULL::VARCHAR AS finding_id, NULL::VARCHAR AS label, NULL::INTEGER AS page,
               NULL::VARCHAR AS workbook, NULL::VARCHAR AS sheet, NULL::VARCHAR AS columns, NULL::INTEGER AS row_offset, NULL::BIGINT AS support, NULL::BIGINT AS overlap FROM arts WHERE name IN {ops.ARTIFACTS}
        UNION ALL SELECT vec_id % {CASES}, 1, vec_id, 'figure', 'f/' || vec_id, 'Figure F' || vec_id, NULL, NULL, 'F' || vec_id, NULL, NULL, 'Fig. ' || (vec_id % 9), (vec_id % 20)::INTEGER, NULL, NULL, NULL, NULL, NULL, NULL FROM embeddings WHERE vec_id % 7 <> 0
        UNION ALL SELECT vec_id % {CASES}, 2, vec_id, 'panel', CASE WHEN vec_id % 2 = 0 THEN 'p/' || vec_id ELSE '' END, 'Panel A' || (vec_id % {7 * CASES}), NULL, NULL, 'F' || vec_id, 'A' || (vec_id % {7 * CASES}), NULL, 'Fig. ' || (vec_id % 9), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM embeddings
        UNION ALL SELECT case_id, 3 + seq % 2, k, 'sheet', coalesce(workbook, ''), CASE WHEN seq % 2 = 0 THEN 'Priority' ELSE 'Pair' END || ' finding ' || finding_id, NULL, NULL, NULL, NULL, finding_id, NULL, NULL, workbook, sheet, NULL, CASE WHEN seq % 2 = 1 THEN row_offset END, support, support + 1 FROM r WHERE k <= 100),
    i AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY source, k, name, figure_id, panel_id, finding_id, source_path) AS n FROM u),
    items AS (SELECT * EXCLUDE (source, k), 'EV-' || {list(ops.SOURCES)}[source + 1] || '-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS evidence_id FROM i)"""
_INDEX_SQL = f"""WITH {_ITEMS_SQL},
    e AS (SELECT case_id, n, evidence_id, 'finding' AS index, finding_id AS key FROM items UNION ALL SELECT case_id, n, evidence_id, 'panel', panel_id FROM items UNION ALL SELECT case_id, n, evidence_id, 'artifact', name FROM items)
    SELECT case_id, index, key, arg_max(evidence_id, n) AS evidence_id FROM e WHERE key IS NOT NULL GROUP BY ALL"""

QUERIES = {
    "evidence_items": items,
    "evidence_indexes": lambda s, d: ops.indexes(items(s, d)),
    "pattern_groups": lambda s, d: ops.pattern_groups(*_report(s, d))[0],
    "pattern_members": lambda s, d: ops.pattern_groups(*_report(s, d))[1],
    "evidence_clusters": lambda s, d: ops.evidence_clusters(*_report(s, d)),
}
SQL = {
    "evidence_items": f"WITH {_ITEMS_SQL} SELECT * FROM items",
    "evidence_indexes": _INDEX_SQL,
    "pattern_groups": _GROUPS_SQL,
    "pattern_members": _MEMBERS_SQL,
    "evidence_clusters": _CLUSTERS_SQL,
}
