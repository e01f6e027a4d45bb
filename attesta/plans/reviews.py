"""Gate, visual, mapping and review queries on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import scalars
from attesta.operators import findings, gates, mapping, pairs, text, visual
from attesta.plans import sheets
from attesta.plans.sheets import read
from attesta.sources import markup

def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two labels of a supplier sheet."""
    labels = sheets.supplier_labels(spark, sf_dir)
    side = lambda s: labels.select("workbook", "sheet", F.col("col").alias(s), F.col("label").alias(f"label_{s}"))
    met = side("left").join(side("right"), ["workbook", "sheet"]).filter("left < right")
    return met.select("sheet", "left", "right", gates.semantic_pair(F.col("label_left"), F.col("label_right")).alias("same"))


_SEMANTIC_SQL = f"WITH {sheets.KNOWN_SQL} SELECT a.sheet, a.col AS \"left\", b.col AS \"right\", " + " OR ".join(f"(regexp_matches(lower(a.label), '{'|'.join(g)}') AND regexp_matches(lower(b.label), '{'|'.join(g)}'))" for g in (
    ("mean", "avg", "average", "sd", "std", "stderr", "sem"), ("median", "iqr", "q1", "q3", "25%", "75%"), ("n", "count", "total", "proportion", "percentage", "%"), ("pre", "post", "baseline", "followup", "t0", "t1"), ("control", "treatment", "case", "case_control"),
)) + " AS same FROM labs a JOIN labs b ON a.sheet = b.sheet AND a.col < b.col"


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column pairs of quantity, discount and tax hold few values on a side, and
    which are running numbers."""
    rows = pairs.row_pairs(sheets.small_cells(spark, sf_dir))
    return gates.designs(rows, gates.PAIR).join(gates.running_numbers(rows, gates.PAIR), gates.PAIR)


_DESIGN_SQL = f"""WITH {sheets.SMALL_SQL}, {sheets.PAIRS_SQL}, s AS (SELECT sheet, l, r, a, b, a - lag(a) OVER w AS sa, b - lag(b) OVER w AS sb FROM pairs WINDOW w AS (PARTITION BY sheet, l, r ORDER BY row))
    SELECT 'lineitem' AS workbook, sheet, l AS "left", r AS "right", count(DISTINCT a) <= 3 OR count(DISTINCT a) * 5 <= count(*) OR count(DISTINCT b) <= 3 OR count(DISTINCT b) * 5 <= count(*) AS design,
           count(*) >= 8 AND count(*) FILTER (a % 1000000 = 0) * 100 >= count(*) * 95 AND count(*) FILTER (b % 1000000 = 0) * 100 >= count(*) * 95 AND count(*) FILTER (sa = 1000000) * 10 >= (count(*) - 1) * 7 AND count(*) FILTER (sb = 1000000) * 10 >= (count(*) - 1) * 7 AS index_like
    FROM s GROUP BY ALL"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and their sums in the supplier sheets."""
    cells, labels = sheets.supplier_cells(spark, sf_dir), sheets.supplier_labels(spark, sf_dir)
    side = lambda s: labels.select("workbook", "sheet", F.col("col").alias(s), F.col("label").alias(f"label_{s}"))
    named = side("left").join(side("right"), ["workbook", "sheet"]).filter("left < right")
    named = named.withColumn("mean", gates.mean_and_sum(F.col("label_left"), F.col("label_right"))).filter("mean IS NOT NULL")
    return gates.summaries(pairs.chosen_pairs(pairs.gathered(cells), named.select(*gates.PAIR, "mean"), ["mean"], gates.count_columns(labels)), gates.PAIR, gates.count_columns(labels))


_SUMMARY_SQL = f"""WITH {sheets.SUPPLIER_SQL}, {sheets.KNOWN_SQL},
    k AS (SELECT a.sheet, a.row, CAST(b.v AS DOUBLE) / a.v AS k FROM cells a JOIN cells b ON a.sheet = b.sheet AND a.row = b.row AND a.col = 2 AND b.col = 5 WHERE a.v <> 0),
    w AS (SELECT sheet, count(DISTINCT CASE WHEN k > 1 AND abs(k - round_even(k, 0)) <= 1e-6 THEN round_even(k, 0) END) AS u FROM k GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (k > 1 AND abs(k - round_even(k, 0)) <= 1e-6) * 10 >= count(*) * 8),
    n AS (SELECT sheet, col FROM labs WHERE regexp_matches(lower(label), 'n total|n=|n |count|number') AND col NOT IN (2, 5)),
    f AS (SELECT sheet, bool_or(ok) AS ok FROM (SELECT n.sheet, n.col, count(*) FILTER (abs(k - v / 1e6) <= 0.001) * 10 >= count(*) * 8 AS ok FROM n JOIN k USING (sheet) JOIN cells c ON c.sheet = n.sheet AND c.col = n.col AND c.row = k.row GROUP BY ALL) GROUP BY sheet)
    SELECT 'lineitem' AS workbook, sheet, 2 AS "left", 5 AS "right", CASE WHEN sheet IN (SELECT sheet FROM n) THEN coalesce(ok, false) ELSE u <= 2 END AS summary FROM w LEFT JOIN f USING (sheet)"""


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as panels: a case per fifty, a figure per five, four rotated hashes."""
    e = read(spark, sf_dir, "embeddings")
    from attesta.operators.similarity import signature

    turned = lambda k: F.concat(F.slice("embedding", k + 1, 64 - k), F.slice("embedding", 1, k)) if k else F.col("embedding")
    rotations = F.array(*[signature(turned(k)) for k in (0, 16, 32, 48)])
    return e.select(F.floor(F.col("vec_id") / 50).alias("case_id"), F.col("vec_id").alias("panel_id"), F.floor(F.col("vec_id") / 5).alias("figure_id"), F.array(F.col("label") % 3, F.lit(7)).alias("types"), rotations.alias("rotations"))


_ROTATION_SQL = """WITH t AS (SELECT vec_id, label, k, embedding[k + 1:] || embedding[:k] AS e FROM embeddings, (SELECT unnest([0, 16, 32, 48]) AS k)),
    h AS (SELECT vec_id, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN e[i] > e[i + 1] THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) AS h FROM t)
    SELECT a.vec_id // 50 AS case_id, a.vec_id AS a, b.vec_id AS b, CAST(min(bit_count(xor(a.h, b.h))) AS INTEGER) AS distance FROM h a JOIN h b ON a.vec_id // 50 = b.vec_id // 50 AND a.vec_id < b.vec_id AND a.vec_id // 5 <> b.vec_id // 5
    GROUP BY a.vec_id, b.vec_id HAVING min(bit_count(xor(a.h, b.h))) <= 20"""


def _relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, sf_dir, "part")
    types = F.element_at(F.array(*map(F.lit, ("Blots", "Graphs", "Flow", "Microscopy", "Body"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    own = p.select(F.col("p_partkey").alias("panel_id"), types.alias("panel_type"), (F.col("p_partkey") % 11 == 0).alias("fallback"))
    method = F.element_at(F.array(*map(F.lit, ("copy_move", "overlap", "dhash"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    rel = p.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") * 7 % 50 + 1).alias("target"), (F.col("p_size") / 50.0).alias("score"), method.alias("method"))
    return rel, own


_VISUAL_SQL = """WITH t AS (SELECT p_partkey AS id, ['Blots', 'Graphs', 'Flow', 'Microscopy', 'Body'][p_partkey % 5 + 1] AS ty, p_partkey % 11 = 0 AS fb FROM part),
    r AS (SELECT p_partkey AS source, p_partkey * 7 % 50 + 1 AS target, p_size / 50.0 AS score, ['copy_move', 'overlap', 'dhash'][p_partkey % 3 + 1] AS method FROM part),
    m AS (SELECT r.*, s.ty, s.fb OR g.fb AS fb, score * CASE s.ty WHEN 'Blots' THEN 1.0 WHEN 'Microscopy' THEN 0.9 WHEN 'Body' THEN 0.6 ELSE 0.2 END AS w FROM r JOIN t s ON s.id = source JOIN t g ON g.id = target WHERE score >= 0.4 AND NOT (method IN ('copy_move', 'overlap') AND s.ty = 'Graphs')),
    k AS (SELECT *, least(CASE WHEN w >= 0.7 THEN 3 WHEN w >= 0.4 THEN 2 WHEN w >= 0.25 THEN 1 ELSE 0 END, CASE WHEN fb OR ty IN ('Graphs', 'Flow') THEN 2 WHEN method = 'overlap' THEN 3 ELSE 4 END) AS rank FROM m)
    SELECT source, target, method, CASE WHEN fb THEN least(score, 0.39) ELSE score END AS score, ['info', 'low', 'medium', 'high', 'critical'][rank + 1] AS risk_level FROM k"""


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    edges = p.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") + 1).alias("target"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 50.0).alias("score"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 51.0).alias("weight"), (F.col("p_size") / 52.0).alias("cosine"))
    return visual.provenance_findings(edges)


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets named for figures against supplier descriptions."""
    names = spark.createDataFrame([(f"Fig. {k}{c}",) for k, c in ((1, "a"), (2, ""), (3, "b"), (12, ""))], "sheet string")
    s = read(spark, sf_dir, "supplier")
    body = F.concat(F.lit("The values of "), F.col("s_name"), F.lit(" are shown in Fig "), (F.col("s_suppkey") % 5).cast("string"), F.lit("a and Figure 2. Short one. "), F.lit("As figure 3 of the text says, balances differ by nation."))
    return mapping.claim_mappings(names, s.select(F.col("s_suppkey").alias("doc_id"), body.alias("text")))


_MAPPING_SQL = """WITH names(sheet, number) AS (VALUES ('Fig. 1a', 1), ('Fig. 2', 2), ('Fig. 3b', 3), ('Fig. 12', 12)),
    said AS (
        SELECT s_suppkey AS doc_id, 0 AS place, 'The values of ' || s_name || ' are shown in Fig ' || CAST(s_suppkey % 5 AS VARCHAR) || 'a and Figure 2.' AS sentence, list_distinct([s_suppkey % 5, 2]) AS cited FROM supplier
        UNION ALL SELECT s_suppkey, 2, 'As figure 3 of the text says, balances differ by nation.', [3] FROM supplier),
    met AS (SELECT sheet, number, doc_id, place, sentence, row_number() OVER (PARTITION BY sheet, number, substr(sentence, 1, 180) ORDER BY doc_id, place) AS k FROM (SELECT doc_id, place, sentence, unnest(cited) AS n FROM said WHERE length(sentence) >= 30) JOIN names ON number = n),
    r AS (SELECT sheet, number, doc_id, CAST(place AS INTEGER) AS place, sentence, CAST(row_number() OVER (PARTITION BY sheet ORDER BY doc_id, place) AS INTEGER) AS rank FROM met WHERE k = 1)
    SELECT * FROM r WHERE rank <= 6"""


def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    files = p.select(F.concat(F.lit("d"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), (F.col("p_partkey") % 120).cast("string"), F.lit(".png")).alias("path")).distinct()
    refs = p.select(F.concat(F.lit("d1/"), (F.col("p_partkey") % 150).cast("string"), F.lit(".png")).alias("ref"))
    return mapping.resolve_images(refs, files)


_REFS_SQL = """WITH f AS (SELECT DISTINCT 'd' || CAST(p_partkey % 3 AS VARCHAR) || '/' || CAST(p_partkey % 120 AS VARCHAR) || '.png' AS path FROM part),
    r AS (SELECT 'd1/' || CAST(p_partkey % 150 AS VARCHAR) || '.png' AS ref FROM part), n AS (SELECT split_part(path, '/', 2) AS name, count(*) AS n, min(path) AS sole FROM f GROUP BY ALL)
    SELECT ref, coalesce(path, CASE WHEN n = 1 THEN sole END) AS path, CASE WHEN path IS NOT NULL THEN 'path' WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM r LEFT JOIN f ON path = ref LEFT JOIN n ON name = split_part(ref, '/', 2)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "dismissed").otherwise("open")
    decisions = o.select(F.col("o_custkey").alias("item_id"), status.alias("status"), F.col("o_orderkey").alias("seq"))
    return mapping.review_counts(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id")), decisions)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return mapping.version_history(o.select(F.col("o_custkey").alias("case_id"), F.year("o_orderdate").alias("version"), F.col("o_orderkey").alias("seq")))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderpriority") == "5-LOW", "skipped").when(F.col("o_totalprice") > 300_000, "fallback").otherwise("done")
    return mapping.quality_flags(o.select(F.col("o_custkey").alias("case_id"), status.alias("status")))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as HTML tables with a header, by region."""
    n = read(spark, sf_dir, "nation")
    row = F.concat(F.lit("<tr class='r'><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td> <b>"), F.col("n_name"), F.lit("</b>&amp;co</td></tr>"))
    whole = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    html = F.concat(F.lit("<table><tr><th>key</th><th>name</th></tr>"), F.col("rows"), F.lit("</table>"))
    return markup.html_cells(whole.select("n_regionkey", html.alias("html")), "n_regionkey", "html")


_TABLES_SQL = """WITH r AS (SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS row, n_nationkey, n_name FROM nation)
    SELECT n_regionkey, row, 0 AS col, CAST(n_nationkey AS VARCHAR) AS body FROM r UNION ALL SELECT n_regionkey, row, 1, n_name || ' &co' FROM r
    UNION ALL SELECT DISTINCT n_regionkey, 0, 0, 'key' FROM nation UNION ALL SELECT DISTINCT n_regionkey, 0, 1, 'name' FROM nation"""


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return visual.verified(p.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") + 1).alias("target"), (F.col("p_size") * 6).alias("inliers"), (F.col("p_partkey") % 7 / 500.0).alias("overlap_source"), (F.col("p_partkey") % 5 / 500.0).alias("overlap_target")), top=50)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as panels of nations: own classes for some, the nation's for others, and
    the wet-lab ones of these."""
    s = read(spark, sf_dir, "supplier")
    own = s.filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("panel_id"), F.lit("chart").alias("class"))
    figures = read(spark, sf_dir, "nation").filter("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("figure_id"), F.when(F.col("n_nationkey") % 3 == 1, "wet_lab").otherwise("mixed").alias("class"))
    placed = visual.panel_class(s.select(F.col("s_suppkey").alias("panel_id"), F.col("s_nationkey").alias("figure_id")), own, figures)
    kept = visual.wet_lab(placed.drop("class"), figures).select("panel_id", F.lit(True).alias("wet"))
    return placed.join(kept, "panel_id", "left").withColumn("wet", F.coalesce("wet", F.lit(False)))


_CLASSES_SQL = """SELECT s_suppkey AS panel_id, s_nationkey AS figure_id, CASE WHEN s_suppkey % 4 = 0 THEN 'chart' WHEN s_nationkey % 3 = 1 THEN 'wet_lab' WHEN s_nationkey % 3 = 2 THEN 'mixed' ELSE 'unknown' END AS class, s_nationkey % 3 > 0 AS wet FROM supplier"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    page = F.concat(F.lit("head **#1** first of "), F.col("s_name"), F.lit("\n**#2**  second\n\nline **#13**"))
    return mapping.split_posts(s.select(F.col("s_suppkey").alias("id"), page.alias("text")))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as hand-written claims against part names and types."""
    claims = spark.createDataFrame([(1, "Brand#1"), (2, "brand#25"), (3, "nothing"), (4, "")], "claim_id int, target string")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("finding_id"), F.col("p_brand").alias("target"), (F.col("p_size") * 100_000 + F.col("p_partkey")).alias("seq"))
    return mapping.first_matches(claims, p)


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    cases = c.select(F.col("c_custkey").alias("case_id"), (F.col("c_acctbal") > 0).alias("has_data"), (F.col("c_nationkey") % 2 == 0).alias("has_code"), (F.col("c_mktsegment") == "BUILDING").alias("reproduced"))
    return mapping.verification_level(cases).groupBy("level").agg(F.count("*").alias("n"))


def json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as pages of nations, each nation a block with a text block in a list."""
    n = read(spark, sf_dir, "nation")
    leaf = F.struct(F.lit("list").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("n_name").alias("text"))).alias("blocks"))
    block = F.struct("n_nationkey", F.lit("nation").alias("type"), F.lit(None).cast("string").alias("text"), F.array(leaf).alias("blocks"))
    whole = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.lit("page").alias("type"), F.array_sort(F.collect_list(block)).alias("blocks"))).alias("tree"))
    return markup.blocks(whole, "n_regionkey", "tree")


_JSON_SQL = """WITH k AS (SELECT n_regionkey, n_name, '0.' || CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS VARCHAR) AS path FROM nation)
    SELECT DISTINCT n_regionkey, '0' AS path, 'page' AS type, CAST(NULL AS VARCHAR) AS text FROM nation UNION ALL SELECT n_regionkey, path, 'nation', NULL FROM k
    UNION ALL SELECT n_regionkey, path || '.0', 'list', NULL FROM k UNION ALL SELECT n_regionkey, path || '.0.0', 'text', n_name FROM k"""


def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as markdown tables of two columns."""
    s = read(spark, sf_dir, "supplier")
    body = F.concat(F.lit("| key | name |\n|---|:-:|\n|"), F.col("s_suppkey").cast("string"), F.lit("|  "), "s_name", F.lit("|\ntext"))
    return markup.pipe_cells(text.lines(s.select("s_suppkey", body.alias("text")), "s_suppkey", "text"), "s_suppkey")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry, panels and phrases over the parts table."""
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(point(F.lit(0.0), F.lit(0.0)), point(size, F.lit(0.0)), point(size, F.lit(3.0)), point(F.lit(0.0), F.lit(3.0)))
    turn = scalars.affine_parts(F.lit(0.0), -size, size, F.lit(0.0))
    box = F.array(F.lit(0), F.lit(0), F.col("p_size"), F.lit(10))
    wide = F.concat(F.char(F.lit(97) + F.col("p_partkey") % 20), F.lit("-"), F.char(F.lit(99) + F.col("p_partkey") % 20))
    found = p.select(
        "p_partkey", scalars.polygon_area(ring).alias("area"), scalars.box_overlap(box, F.array(F.lit(5), F.lit(4), F.lit(20), F.lit(20))).alias("overlap"), F.round(turn["angle"]).alias("angle"), turn["scale"].alias("scale"), turn["flipped"].alias("flipped"),
        F.array_join(scalars.panel_range(wide), "").alias("panels"), scalars.row_range(F.concat(F.col("p_size").cast("string"), F.lit(" - 60")))["start"].alias("first_row"), scalars.parse_number(F.concat(F.lit("1,0"), F.format_string("%02d", "p_size"), F.lit("%"))).alias("number"),
        scalars.figure_key(F.concat(F.lit("ED Fig. "), F.col("p_size").cast("string"), F.lit("b")))["number"].alias("figure"), F.array_join(scalars.found_phrases(F.col("p_name"), ["almond", "blue", "part", "zz"]), ",").alias("phrases"), scalars.hamming(F.col("p_partkey").cast("long"), F.col("p_size").cast("long")).alias("bits"), scalars.clamp(size / 30).alias("clamped"),
    )
    return found


_SHAPES_SQL = """SELECT p_partkey, p_size * 3.0 AS area, greatest(0, least(p_size, 25) - 5) * 6 AS overlap, 90.0 AS angle, CAST(p_size AS DOUBLE) AS scale, false AS flipped,
    chr(CAST(97 + p_partkey % 20 AS INTEGER)) || chr(CAST(98 + p_partkey % 20 AS INTEGER)) || chr(CAST(99 + p_partkey % 20 AS INTEGER)) AS panels, p_size AS first_row, CAST(1000 + p_size AS DOUBLE) AS number, p_size AS figure,
    array_to_string(list_filter(['almond', 'blue', 'part', 'zz'], lambda x: contains(lower(p_name), x)), ',') AS phrases, CAST(bit_count(xor(p_partkey, CAST(p_size AS BIGINT))) AS INTEGER) AS bits, least(1.0, p_size / 30) AS clamped FROM part"""


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures are customers, panels their orders."""
    return visual.over_segmented(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("figure_id")))


def merged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' mappings refined by hand, and those of all orders' customers."""
    refined = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mapping_id"), F.col("s_name").alias("claim"))
    derived = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mapping_id"), F.col("c_name").alias("claim"))
    return findings.merge_claims(refined, derived)


QUERIES = {
    "json_blocks": json_blocks,
    "pipe_tables": pipe_tables,
    "shape_functions": shapes,
    "over_segmented": segmented,
    "merged_claims": merged_claims,
    "html_tables": tables,
    "html_lists": lambda s, d: markup.elements(read(s, d, "pages"), "li", "page_id", "html"),
    "verified_matches": keypoints,
    "panel_classes": classes,
    "forum_posts": posts,
    "first_matches": matches,
    "verification_levels": levels,
    "semantic_pairs": semantic,
    "summary_pairs": summaries,
    "pair_designs": designs,
    "rotation_pairs": lambda s, d: visual.rotation_pairs(panels(s, d)),
    "visual_findings": lambda s, d: visual.visual_findings(*_relations(s, d)),
    "provenance_findings": provenance,
    "claim_mappings": mappings,
    "image_references": image_refs,
    "review_counts": reviews,
    "version_history": versions,
    "quality_flags": flags,
}

SQL = {
    "json_blocks": _JSON_SQL,
    "pipe_tables": "SELECT s_suppkey, 1 AS line, 0 AS col, 'key' AS body FROM supplier UNION ALL SELECT s_suppkey, 1, 1, 'name' FROM supplier UNION ALL SELECT s_suppkey, 3, 0, CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT s_suppkey, 3, 1, s_name FROM supplier",
    "shape_functions": _SHAPES_SQL,
    "over_segmented": "SELECT o_custkey AS figure_id, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 16",
    "merged_claims": "SELECT s_suppkey AS mapping_id, s_name AS claim FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "html_tables": _TABLES_SQL,
    "html_lists": r"""WITH f AS (SELECT page_id, regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>', 1) AS xs FROM pages), e AS (SELECT page_id, xs, unnest(range(1, len(xs) + 1)) AS k FROM f)
        SELECT page_id, CAST(k - 1 AS INTEGER) AS place, trim(regexp_replace(regexp_replace(xs[k], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM e""",
    "verified_matches": """SELECT p_partkey AS source, p_partkey + 1 AS target, p_size * 6 AS inliers, p_partkey % 7 / 500.0 AS overlap_source, p_partkey % 5 / 500.0 AS overlap_target, least(1.0, p_size * 6 / 200.0) AS score FROM part
        WHERE p_size * 6 >= 10 AND (p_partkey % 7 / 500.0 >= 0.01 OR p_partkey % 5 / 500.0 >= 0.01) ORDER BY score DESC, source, target LIMIT 50""",
    "panel_classes": _CLASSES_SQL,
    "forum_posts": """SELECT s_suppkey AS id, 1 AS comment, 'first of ' || s_name AS body FROM supplier UNION ALL SELECT s_suppkey, 2, 'second line' FROM supplier UNION ALL SELECT s_suppkey, 13, '' FROM supplier""",
    "first_matches": """WITH c(claim_id, target) AS (VALUES (1, 'Brand#1'), (2, 'brand#25'), (3, 'nothing'), (4, '')),
        m AS (SELECT claim_id, arg_min(p_partkey, p_size * 100000 + p_partkey) AS finding_id FROM c JOIN part ON c.target <> '' AND contains(lower(p_brand), lower(c.target)) GROUP BY claim_id)
        SELECT claim_id, finding_id, CASE WHEN finding_id IS NULL THEN 'gap' ELSE 'covered' END AS status FROM c LEFT JOIN m USING (claim_id)""",
    "verification_levels": """WITH c AS (SELECT c_acctbal > 0 AS d, c_nationkey % 2 = 0 AS k, c_mktsegment = 'BUILDING' AS r FROM customer)
        SELECT CASE WHEN d AND k AND r THEN 'V3' WHEN d AND k THEN 'V2' WHEN d OR k THEN 'V1' ELSE 'V0' END AS level, count(*) AS n FROM c GROUP BY ALL""",
    "semantic_pairs": _SEMANTIC_SQL,
    "summary_pairs": _SUMMARY_SQL,
    "pair_designs": _DESIGN_SQL,
    "rotation_pairs": _ROTATION_SQL,
    "visual_findings": _VISUAL_SQL,
    "provenance_findings": """WITH e AS (SELECT p_partkey AS source, p_partkey + 1 AS target, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size / 50.0 END, CASE WHEN p_partkey % 2 = 0 THEN p_size / 51.0 END, p_size / 52.0) AS strength FROM part)
        SELECT source, target, strength FROM e WHERE strength >= 0.85 ORDER BY strength DESC, source, target LIMIT 30""",
    "claim_mappings": _MAPPING_SQL,
    "image_references": _REFS_SQL,
    "review_counts": """WITH d AS (SELECT o_custkey, arg_max(CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'dismissed' ELSE 'open' END, o_orderkey) AS status FROM orders GROUP BY ALL)
        SELECT coalesce(status, 'open') AS status, count(*) AS n FROM customer LEFT JOIN d ON o_custkey = c_custkey GROUP BY ALL""",
    "version_history": "WITH v AS (SELECT o_custkey AS case_id, CAST(year(o_orderdate) AS INTEGER) AS version, max(o_orderkey) AS seq FROM orders GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY version) - 1 AS INTEGER) AS prior FROM v",
    "quality_flags": """WITH s AS (SELECT o_custkey AS case_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderpriority = '5-LOW' THEN 'skipped' WHEN o_totalprice > 300000 THEN 'fallback' ELSE 'done' END AS flag FROM orders)
        SELECT case_id, flag, CASE flag WHEN 'failed' THEN 'high' WHEN 'fallback' THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM s WHERE flag <> 'done' GROUP BY ALL""",
}
