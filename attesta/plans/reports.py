"""Report, ledger and image queries on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import reports as ops
from attesta.operators import similarity, text
from attesta.plans.sheets import read, spread

_CATEGORIES = ("duplicate_row_vector", "fixed_ratio", "paperfraud.methodology_review", "benford_analysis", "offset_mismatch", "missing_panel")
_RISKS = ("critical", "high", "medium", "low", "info")


def _pick(values: tuple[str, ...], key: str, every: int = 1):
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col(key) / every) % len(values) + 1).cast("int"))


def _list(values: tuple[str, ...], key: str, every: int = 1) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{key} // {every} % {len(values)} + 1]"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as findings of all categories and risks."""
    p = read(spark, sf_dir, "part")
    source = F.when(F.col("p_partkey") % 7 == 0, "numeric_forensics.json").otherwise("source_data.json")
    refs = F.slice(F.array(F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.lit("last")), 1, (F.col("p_partkey") % 5).cast("int"))
    reasons = F.slice(F.array(F.lit("unit change"), F.lit("copy"), F.lit("rounding")), 1, (F.col("p_partkey") % 4).cast("int"))
    return p.select(F.col("p_partkey").alias("finding_id"), _pick(_CATEGORIES, "p_partkey").alias("category"), _pick(_RISKS, "p_partkey", 6).alias("risk_level"), source.alias("source_artifact"), F.when(F.col("p_partkey") % 11 > 0, F.col("p_name")).alias("summary"), refs.alias("evidence_refs"), reasons.alias("explanations"))


_FINDINGS = f"""f AS (SELECT p_partkey AS finding_id, {_list(_CATEGORIES, 'p_partkey')} AS category, {_list(_RISKS, 'p_partkey', 6)} AS risk_level,
    CASE WHEN p_partkey % 7 = 0 THEN 'numeric_forensics.json' ELSE 'source_data.json' END AS source_artifact, CASE WHEN p_partkey % 11 > 0 THEN p_name END AS summary,
    [p_brand, p_type, p_name, 'last'][1:p_partkey % 5] AS refs, ['unit change', 'copy', 'rounding'][1:p_partkey % 4] AS reasons FROM part)"""
_LAYER = "CASE WHEN category IN ('duplicate_row_vector', 'paperfraud.methodology_review') THEN 3 WHEN risk_level IN ('critical', 'high') THEN CASE WHEN regexp_matches(category || source_artifact, 'paperfraud|numeric_forensics|benford|digit') THEN 2 ELSE 1 END WHEN risk_level = 'medium' THEN 2 ELSE 3 END"
_RANK = "CASE risk_level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"

_CERTAINTY = f"""WITH {_FINDINGS}, t AS (SELECT *, array_to_string(refs[1:3], ', ') AS r, array_to_string(reasons[1:2], '; ') AS e,
        CASE WHEN category LIKE '%duplicate%' THEN 'repeated rows or columns' WHEN regexp_matches(category, 'offset|fixed') THEN 'the fixed difference or offset' WHEN regexp_matches(category, 'mismatch|inconsisten') THEN 'the data against the statement' END AS topic FROM f)
    SELECT finding_id, category, risk_level, coalesce(summary, 'An unusual pattern was found') || CASE WHEN r <> '' THEN '. Evidence: ' || r ELSE '' END || '.' AS fact,
           CASE WHEN e <> '' THEN 'Possible reasons: ' || e ELSE 'No harmless explanation is known' END || '. This is an inference, not a verdict.' AS inference,
           CASE WHEN risk_level IN ('critical', 'high') AND topic IS NOT NULL THEN 'High risk: check ' || topic || ' first and record it.' WHEN risk_level IN ('critical', 'high') THEN 'High risk: have it reviewed first and record it.'
                WHEN topic IS NOT NULL THEN 'Check ' || topic || ' or explain it.' WHEN regexp_matches(category, 'missing|completeness') THEN 'Supply the missing data or say why it is missing.'
                WHEN risk_level = 'medium' THEN 'Have it reviewed for consistency.' ELSE 'Have it reviewed.' END AS suggestion FROM t"""


def client(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    o = read(spark, sf_dir, "orders")
    reviews = o.select(F.col("o_custkey").alias("finding_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("dismissed").alias("status"))
    details = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("finding_id"), F.col("s_name").alias("detail"))
    return ops.client_report(found.select("finding_id", "category", "risk_level"), ops.certainty(found), reviews, details)


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return ops.first_by_id(o.select(F.col("o_custkey").alias("finding_id"), F.col("o_orderkey").alias("seq"), "o_orderstatus", "o_orderpriority"), "finding_id", "seq")


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return ops.tiers(p.select(F.col("p_partkey").alias("pattern_id"), (F.col("p_size") * 1_000_000 + F.col("p_partkey")).alias("seq"), _pick(_RISKS, "p_partkey").alias("risk_level"), (F.col("p_partkey") % 3 == 0).alias("consistency")))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three regions of high key, then nations, up to five rows in all."""
    r = read(spark, sf_dir, "region").filter("r_regionkey > 1").select(F.lit("findings").alias("source"), F.col("r_regionkey").alias("seq"), F.col("r_name").alias("category"))
    n = read(spark, sf_dir, "nation").select(F.lit("forensics").alias("source"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("category"))
    return ops.context_top([r, n], 5)


def runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return ops.performance(s.select(F.col("s_suppkey").alias("agent_step"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).alias("runtime_seconds")))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    quality = F.when(F.col("p_partkey") % 2 == 0, "whole_figure_fallback").when(F.col("p_partkey") % 3 == 0, "good")
    return ops.visual_queue(p.select(F.col("p_partkey").alias("cluster_id"), F.col("p_brand").alias("category"), F.when(F.col("p_partkey") % 5 > 0, _pick(_RISKS, "p_partkey")).alias("risk_level"), F.col("p_size").alias("finding_count"), quality.alias("quality"), (F.col("p_size") * 1_000_000 + F.col("p_partkey")).alias("seq")))


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    path = F.when(F.col("p_partkey") % 10 > 0, F.concat("p_brand", F.lit("/"), "p_size"))
    return ops.ledger_figures(p.select(F.col("p_partkey").alias("id"), path.alias("path"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey") % 30).alias("page"), F.col("p_partkey").alias("seq")))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as triggered rules; findings and checklist in one list."""
    p = read(spark, sf_dir, "part")
    excerpts = F.slice(F.array("p_name", "p_type"), 1, (F.col("p_partkey") % 3).cast("int"))
    rows = p.select(F.concat(F.lit("R "), F.col("p_partkey").cast("string")).alias("rule_id"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).alias("rule_type"), _pick(("red", "orange", "yellow", "green", "blue"), "p_partkey").alias("severity"), F.when(F.col("p_partkey") % 6 > 0, F.col("p_name")).alias("title"), excerpts.alias("excerpts"))
    found, checklist = ops.rule_findings(rows)
    return found.withColumn("kind", F.lit("finding")).unionByName(checklist.select(F.col("rule_id").alias("finding_id"), F.col("rule_type").alias("category"), F.col("severity").alias("risk_level"), F.col("title").alias("summary"), F.lit(0).alias("n_excerpts"), F.lit("checklist").alias("kind")))


_RULES_SQL = f"""WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE 'methodology_review' END AS ty, {_list(("red", "orange", "yellow", "green", "blue"), 'p_partkey')} AS sev, CASE WHEN p_partkey % 6 > 0 THEN p_name ELSE 'R ' || p_partkey END AS title FROM part)
    SELECT CASE WHEN k % 3 > 0 THEN 'PF-R-' || k ELSE 'R ' || k END AS finding_id, CASE WHEN k % 3 > 0 THEN 'paperfraud.' || ty ELSE ty END AS category,
           CASE WHEN k % 3 > 0 THEN CASE sev WHEN 'red' THEN 'high' WHEN 'orange' THEN 'medium' WHEN 'green' THEN 'info' ELSE 'low' END ELSE sev END AS risk_level, title AS summary, CAST(k % 3 AS INTEGER) AS n_excerpts, CASE WHEN k % 3 > 0 THEN 'finding' ELSE 'checklist' END AS kind FROM r"""


def sheet_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as claims that name their nations; nations as workbooks with a sheet each."""
    n = read(spark, sf_dir, "nation")
    claims = n.groupBy(F.col("n_regionkey").alias("claim_id")).agg(F.collect_list(F.concat(F.lit("see "), "n_name", F.lit(".XLSX"))).alias("refs"))
    return ops.claims_of_sheets(claims, n.select(F.concat("n_name", F.lit(".xlsx")).alias("workbook"), F.concat(F.lit("sheet "), "n_nationkey").alias("sheet")))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "Measurement").otherwise("metadata").alias("type"))
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pairs = n.select(F.col("n_name").alias("name_l"), (F.col("n_nationkey") + 1).alias("k")).join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name_r")), "k").drop("k")
    return ops.measured_columns(pairs, types)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    finding = F.struct(F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").alias("severity"), F.col("o_orderpriority").alias("kind"))
    return ops.scan_summary(o.groupBy("o_custkey").agg(F.collect_list(finding).alias("l")).select(F.array("l").alias("lists")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return ops.derived_pages(p.select(F.when(F.col("p_partkey") % 9 > 0, F.col("p_size")).alias("page")), p.filter("p_size <= 10").select(F.col("p_size").alias("page")).distinct())


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return ops.ledger_index(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("type"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("page"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("path"), F.when(F.col("p_partkey") % 5 > 0, (F.col("p_partkey") % 40).cast("int")).alias("line_start"), F.when(F.col("p_partkey") % 4 > 0, (F.col("p_partkey") % 40 + F.col("p_size") % 3).cast("int")).alias("line_end")))


_INDEX_SQL = """WITH i AS (SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 5 THEN p_brand END, 'unknown') AS ty, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS page, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS path,
        CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 40 END AS a, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 40 + p_size % 3 ELSE p_partkey % 40 END AS b FROM part),
    e AS (SELECT 'by_type' AS index, ty AS key, id FROM i UNION ALL SELECT 'by_page', CAST(page AS VARCHAR), id FROM i WHERE page IS NOT NULL UNION ALL SELECT 'by_image_path', path, id FROM i WHERE path IS NOT NULL
        UNION ALL SELECT 'by_markdown_line', CAST(unnest(range(a, b + 1)) AS VARCHAR), id FROM i WHERE a IS NOT NULL)
    SELECT index, key, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS ids FROM e GROUP BY index, key"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as images; each is linked with the next ones, with weights by their balances."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    near = s.select("s_suppkey", "s_acctbal", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("k"))
    other = s.select((F.col("s_suppkey")).alias("b"), F.col("s_acctbal").alias("z"))
    edges = near.withColumn("b", F.col("s_suppkey") + F.col("k")).join(other, "b").filter("s_suppkey % 10 > 0 OR k > 1")
    return ops.spanning_tree(edges.select(F.col("s_suppkey").alias("a"), "b", F.abs(F.col("s_acctbal") - F.col("z")).alias("weight")))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images of 12 by 10 pixels: flat ones, framed ones, bright ones, noise."""
    k = F.col("p_partkey")
    place = F.sequence(F.lit(0), F.lit(119))
    value = lambda i: F.when(k % 4 == 0, F.lit(7)).when(k % 4 == 1, F.when((i % 12 == 0) | (i % 12 == 11) | (i < 12) | (i >= 108), 40 + i % 2).otherwise((i * 31 + k) % 200)).when(k % 4 == 2, 252 + i % 3).otherwise((i * 37 + k * 11) % 256)
    return ops.gray_anomalies(spread(read(spark, sf_dir, "part").select("p_partkey")).select(k.alias("image_id"), F.lit(12).alias("width"), F.lit(10).alias("height"), F.transform(place, lambda i: value(i).cast("int")).alias("pixels")))


_GRAY_SQL = """WITH px AS (SELECT p_partkey AS k, i, i % 12 = 0 OR i % 12 = 11 OR i < 12 OR i >= 108 AS edge FROM part, (SELECT unnest(range(120)) AS i)),
    v AS (SELECT k, edge, CASE k % 4 WHEN 0 THEN 7 WHEN 1 THEN CASE WHEN edge THEN 40 + i % 2 ELSE (i * 31 + k) % 200 END WHEN 2 THEN 252 + i % 3 ELSE (i * 37 + k * 11) % 256 END AS v FROM px),
    c AS (SELECT k, v, count(*) AS n, count(*) FILTER (edge) AS nb FROM v GROUP BY ALL),
    m AS (SELECT k, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY nb DESC, v) AS rn FROM c) WHERE rn = 1),
    s AS (SELECT c.k, sum(n * v) / sum(n) AS mean, max(n) / sum(n) AS most, sum(nb) FILTER (abs(v - mode) <= 2) / sum(nb) AS border FROM c JOIN m USING (k) GROUP BY c.k)
    SELECT k AS image_id, 'uniform_border' AS anomaly_type, 'high' AS severity FROM s WHERE border > 0.95 UNION ALL SELECT k, 'globally_uniform', 'medium' FROM s WHERE most > 0.8 UNION ALL SELECT k, 'near_solid_color', 'high' FROM s WHERE mean > 250 OR mean < 5"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as tiles: forty make a case, four a panel."""
    turned = lambda k: F.concat(F.slice("embedding", k + 1, 64 - k), F.slice("embedding", 1, k)) if k else F.col("embedding")
    rotations = F.array(*[similarity.signature(turned(k)) for k in (0, 16, 32, 48)])
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 40).alias("case_id"), F.col("vec_id").alias("tile_id"), F.floor(F.col("vec_id") / 4).alias("panel_id"), rotations.alias("rotations"))


_TILES_SQL = """WITH t AS (SELECT vec_id, k, embedding[k * 16 + 1:] || embedding[:k * 16] AS e FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS k)),
    h AS (SELECT vec_id, k, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN e[i] > e[i + 1] THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) AS h FROM t),
    d AS (
        SELECT a.vec_id // 40 AS case_id, a.vec_id AS a, b.vec_id AS b, a.vec_id // 4 AS source, b.vec_id // 4 AS target, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance, (b.k - a.k + 4) % 4 * 90 AS angle
        FROM h a JOIN h b ON a.vec_id // 40 = b.vec_id // 40 AND a.vec_id < b.vec_id AND a.vec_id // 4 <> b.vec_id // 4),
    best AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY distance, angle) AS rn FROM d),
    near AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, a, b) AS place FROM best WHERE rn = 1 AND distance <= 24)
    SELECT case_id, source, target, count(*) AS n_tiles, min(distance) AS best_distance, CAST(arg_min(angle, (distance, a, b)) AS INTEGER) AS best_angle FROM near WHERE place <= 500 GROUP BY ALL"""


def legend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as texts with two figure headings, one of them twice, and another heading."""
    n = read(spark, sf_dir, "nation")
    body = F.concat(F.lit("intro\n# Fig. 1 | Cells of "), "n_name", F.lit("\na, first line\n\nb, second\n## Methods\nnothing\n# Extended Data  Fig. 2\nlast of "), "n_nationkey", F.lit("\n# Fig. 1\nagain"))
    return ops.legends(text.lines(n.select("n_nationkey", body.alias("text")), "n_nationkey", "text"), "n_nationkey")


def briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as findings; brands are workbooks and sizes sheets."""
    p = read(spark, sf_dir, "part")
    return ops.sheet_briefing(p.select(F.col("p_brand").alias("workbook"), (F.col("p_size") % 3).cast("string").alias("sheet"), F.format_string("F-%06d", "p_partkey").alias("finding_id"), _pick(_CATEGORIES, "p_partkey").alias("category"), _pick(_RISKS, "p_partkey", 6).alias("risk_level")))


_BRIEFING_SQL = f"""WITH f AS (SELECT p_brand AS workbook, CAST(p_size % 3 AS VARCHAR) AS sheet, 'F-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS finding_id, {_list(_CATEGORIES, 'p_partkey')} AS category, {_list(_RISKS, 'p_partkey', 6)} AS risk_level FROM part),
    k AS (SELECT *, {_RANK} AS r, row_number() OVER (PARTITION BY workbook, sheet, category ORDER BY finding_id) AS k FROM f),
    g AS (SELECT workbook, sheet, category, count(*) AS n, ['info', 'low', 'medium', 'high', 'critical'][max(r) + 1] AS max_risk, string_agg(finding_id, ',' ORDER BY finding_id) FILTER (k <= 50) AS finding_ids FROM k GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY workbook, sheet ORDER BY n DESC, category) AS INTEGER) AS place FROM g"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as samples that findings show; several show the same row."""
    li = read(spark, sf_dir, "lineitem")
    return ops.sample_rows(li.select(F.lit("lineitem").alias("workbook"), (F.col("l_suppkey") % 7).cast("string").alias("sheet"), (F.col("l_partkey") % 90).alias("row"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("sample")))


QUERIES = {
    "sheet_briefing": briefing,
    "sample_rows": samples,
    "judge_input": lambda s, d: ops.judge_input(findings(s, d)).groupBy("category", "risk_level", "layer").agg(F.count("*").alias("n")),
    "top_findings": lambda s, d: ops.top_findings(findings(s, d), 25).select("finding_id", "risk_level"),
    "certainty_texts": lambda s, d: ops.certainty(findings(s, d)),
    "client_report": client,
    "first_by_id": dedupe,
    "pattern_tiers": tiered,
    "context_top": context,
    "performance": runtimes,
    "visual_queue": queue,
    "ledger_figures": figures,
    "rule_findings": rules,
    "sheet_claims": sheet_claims,
    "measured_columns": measured,
    "scan_summary": scans,
    "derived_pages": pages,
    "ledger_index": index,
    "spanning_tree": tree,
    "gray_anomalies": gray,
    "tile_pairs": lambda s, d: ops.tile_candidates(tiles(s, d))[1],
    "figure_legends": legend_rows,
}

SQL = {
    "sheet_briefing": _BRIEFING_SQL,
    "sample_rows": """WITH l AS (SELECT 'lineitem' AS workbook, CAST(l_suppkey % 7 AS VARCHAR) AS sheet, l_partkey % 90 AS row, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS sample FROM lineitem GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row) AS k, count(*) OVER (PARTITION BY sheet) AS total FROM l) SELECT workbook, sheet, row, sample, total FROM k WHERE k <= 50""",
    "judge_input": f"WITH {_FINDINGS}, l AS (SELECT *, {_LAYER} AS layer FROM f) SELECT category, risk_level, layer, count(*) AS n FROM l WHERE layer < 3 GROUP BY ALL",
    "top_findings": f"WITH {_FINDINGS} SELECT finding_id, risk_level FROM f ORDER BY {_RANK} DESC, finding_id LIMIT 25",
    "certainty_texts": _CERTAINTY,
    "client_report": f"""WITH t AS ({_CERTAINTY}), last AS (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'dismissed' END, o_orderkey) AS status FROM orders GROUP BY ALL)
        SELECT finding_id, category, risk_level, fact, coalesce(status, 'open') AS status, s_name AS detail FROM t LEFT JOIN last ON o_custkey = finding_id LEFT JOIN supplier ON s_suppkey = finding_id""",
    "first_by_id": "SELECT o_custkey AS finding_id, min(o_orderkey) AS seq, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey",
    "pattern_tiers": f"""WITH p AS (SELECT p_partkey AS pattern_id, p_size * 1000000 + p_partkey AS seq, {_list(_RISKS, 'p_partkey')} AS risk_level, p_partkey % 3 = 0 AS consistency FROM part),
        k AS (SELECT pattern_id FROM p WHERE risk_level IN ('critical', 'high') AND consistency ORDER BY seq, pattern_id LIMIT 20)
        SELECT p.*, CASE WHEN pattern_id IN (SELECT pattern_id FROM k) THEN 'primary' ELSE 'secondary' END AS tier FROM p""",
    "context_top": "SELECT 'findings' AS source, r_regionkey AS seq, r_name AS category FROM region WHERE r_regionkey > 1 UNION ALL SELECT * FROM (SELECT 'forensics', n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 2)",
    "performance": "SELECT s_suppkey AS agent_step, s_acctbal AS runtime_seconds, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS place FROM supplier WHERE s_suppkey % 3 > 0",
    "visual_queue": f"""WITH c AS (SELECT *, row_number() OVER (ORDER BY p_size * 1000000 + p_partkey) AS k, CASE WHEN p_partkey % 5 > 0 THEN {_list(_RISKS, 'p_partkey')} ELSE 'medium' END AS risk FROM part QUALIFY k <= 20)
        SELECT 'VRT-' || lpad(CAST(k AS VARCHAR), 3, '0') AS task_id, p_partkey AS cluster_id, p_brand AS category, CASE WHEN p_partkey % 2 = 0 AND risk IN ('critical', 'high') THEN 'medium' ELSE risk END AS priority, p_size AS finding_count,
               CASE WHEN p_partkey % 2 = 0 THEN 'whole_figure_fallback' WHEN p_partkey % 3 = 0 THEN 'good' ELSE 'unknown' END AS quality FROM c""",
    "ledger_figures": """WITH f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 > 0 THEN p_brand || '/' || p_size END AS path, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 30 END AS page, p_partkey AS seq FROM part)
        SELECT id, path, page, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page IS NULL, seq) AS rn FROM f WHERE path IS NOT NULL) WHERE rn = 1 UNION ALL SELECT * FROM f WHERE path IS NULL""",
    "rule_findings": _RULES_SQL,
    "sheet_claims": """SELECT DISTINCT n.n_name || '.xlsx' AS workbook, 'sheet ' || n.n_nationkey AS sheet, c.n_regionkey AS claim_id FROM nation n JOIN nation c ON contains('see ' || lower(c.n_name) || '.xlsx', lower(n.n_name) || '.xlsx') OR contains('see ' || lower(c.n_name) || '.xlsx', 'sheet ' || n.n_nationkey)""",
    "measured_columns": "SELECT a.n_name AS name_l, b.n_name AS name_r FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_nationkey % 3 = 0 OR b.n_nationkey % 3 = 0",
    "scan_summary": """WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS severity, o_orderpriority AS kind FROM orders)
        SELECT severity, kind, count(*) AS n, CAST(grouping(severity, kind) AS INTEGER) AS level FROM r GROUP BY ROLLUP (severity, kind)""",
    "derived_pages": "WITH k AS (SELECT DISTINCT p_size FROM part WHERE p_size <= 10), f AS (SELECT DISTINCT p_size AS page FROM part WHERE p_partkey % 9 > 0 AND p_size NOT IN (SELECT p_size FROM k)) SELECT 'page-' || lpad(CAST((SELECT count(*) FROM k) + row_number() OVER (ORDER BY page) AS VARCHAR), 4, '0') AS id, page FROM f",
    "ledger_index": _INDEX_SQL,
    "gray_anomalies": _GRAY_SQL,
    "tile_pairs": _TILES_SQL,
    "figure_legends": """SELECT n_nationkey, 'Fig. 1' AS label, 'again' AS legend FROM nation UNION ALL SELECT n_nationkey, 'Extended Data Fig. 2', 'last of ' || n_nationkey FROM nation""",
}
