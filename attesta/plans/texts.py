"""Text, claim, image-hash and scalar queries on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import scalars
from attesta.operators import profile, similarity, text
from attesta.plans.sheets import read

#: (rule_id, severity, enabled, pattern, negative): a small rule base for the documents.
RULES = [
    ("R1", "red", True, "worthless|moron", None),
    ("R2", "orange", True, r"api_?key|password", None),
    ("R3", "yellow", True, r"[0-9]{3}\.[0-9]+\.[0-9]+", "password"),
    ("R4", "yellow", False, "the", None),
]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, severity string, enabled boolean, pattern string, negative string")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.match_rules(read(spark, sf_dir, "documents"), _rules(spark))


def _quoted(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + str(x) + "'"


_RULES_SQL = "rules(rule_id, severity, enabled, pattern, negative) AS (VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in RULES) + ")"
_MATCH_SQL = f"""{_RULES_SQL},
    m AS (
        SELECT doc_id, rule_id, severity, text, strpos(lower(text), regexp_extract(lower(text), pattern)) AS hit FROM documents, rules
        WHERE enabled AND length(trim(text)) > 0 AND regexp_matches(lower(text), pattern) AND (negative IS NULL OR NOT regexp_matches(lower(text), negative)))"""

_NUMBERS = r"""numbers AS (
    SELECT doc_id, line, CAST(place - 1 AS INTEGER) AS place, raws[place] AS raw FROM (
        SELECT doc_id, line, raws, unnest(range(1, len(raws) + 1)) AS place FROM (
            SELECT doc_id, line, regexp_extract_all(lines[line], '(^|[^A-Za-z0-9_.-])([-+]?\d+(?:,\d{3})*(?:\.\d+)?%?)', 2) AS raws FROM (
                SELECT doc_id, lines, CAST(unnest(range(1, len(lines) + 1)) AS INTEGER) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))))"""

_KINDS = r"""lines AS (SELECT doc_id, line, lines[line] AS body FROM (SELECT doc_id, lines, CAST(unnest(range(1, len(lines) + 1)) AS INTEGER) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
    kinds AS (
        SELECT *, CASE WHEN trim(body) = '' THEN 'blank' WHEN regexp_matches(trim(body), '^!\[[^\]]*\]\([^)]*\)') THEN 'image' WHEN starts_with(trim(body), '|') OR starts_with(lower(trim(body)), '<table') THEN 'table'
               WHEN regexp_matches(lower(trim(body)), '^(fig(ure|\.)?|table|extended data fig)\s*\.?\s*[0-9]+') THEN 'caption' WHEN starts_with(trim(body), '#') THEN 'heading' ELSE 'text' END AS kind FROM lines),
    marked AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line) <> kind, true) AS changed FROM kinds),
    placed AS (SELECT *, sum(CAST(changed AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM marked)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders claim the sum of their lines; every seventh result is text, later rows win."""
    orders = read(spark, sf_dir, "orders")
    said = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("dataset"), F.lit("lines").alias("metric"), (F.col("o_orderkey") % 6).cast("double").alias("expected"), F.lit(0.5).alias("tolerance"))
    counts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").count()
    result = F.when(F.col("l_orderkey") % 7 == 0, "n/a").otherwise(F.col("count").cast("string"))
    first = counts.select(F.col("l_orderkey").cast("string").alias("dataset"), F.lit("lines").alias("metric"), F.lit("0").alias("value"), F.lit(1).alias("seq"))
    last = counts.select(F.col("l_orderkey").cast("string").alias("dataset"), F.lit("lines").alias("metric"), result.alias("value"), F.lit(2).alias("seq"))
    return text.reconcile_claims(said, first.unionByName(last))


_CLAIM_SQL = """WITH r AS (SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(count(*) AS VARCHAR) END AS value FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS dataset, 'lines' AS metric, CAST(o_orderkey % 6 AS DOUBLE) AS expected, TRY_CAST(value AS DOUBLE) AS actual,
           CASE WHEN value IS NULL THEN 'missing' WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN 'unparsed' WHEN abs(TRY_CAST(value AS DOUBLE) - o_orderkey % 6) > 0.5 THEN 'mismatched' ELSE 'matched' END AS status
    FROM orders LEFT JOIN r ON o_orderkey = l_orderkey"""


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures are nations, panels market segments and brands' first letters: which
    segments have no customer with a negative balance."""
    c = read(spark, sf_dir, "customer")
    expected = c.select(F.col("c_nationkey").alias("figure"), F.col("c_mktsegment").alias("panel"))
    covered = c.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("figure"), F.col("c_mktsegment").alias("panel")).distinct()
    return text.missing_panels(expected, covered)


_MISSING_SQL = """WITH e AS (SELECT DISTINCT c_nationkey AS figure, c_mktsegment AS panel FROM customer), c AS (SELECT DISTINCT c_nationkey AS figure, c_mktsegment AS panel FROM customer WHERE c_acctbal < 0)
    SELECT figure, count(*) AS n_missing, string_agg(panel, ',' ORDER BY panel) AS panels FROM e ANTI JOIN c USING (figure, panel) GROUP BY figure"""


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    items = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("item_id"), F.concat("p_brand", F.col("p_size").cast("string")).alias("label"), F.floor(F.col("p_partkey") / 4).alias("page"))
    caps = p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("caption_id"), F.concat("p_brand", F.col("p_size").cast("string")).alias("label"), F.floor(F.col("p_partkey") / 4).alias("page"))
    return text.link_captions(caps, items)


_CAPTION_SQL = """WITH i AS (SELECT p_partkey AS item_id, p_brand || CAST(p_size AS VARCHAR) AS label, p_partkey // 4 AS page FROM part WHERE p_partkey % 2 = 0),
    c AS (SELECT p_partkey AS caption_id, p_brand || CAST(p_size AS VARCHAR) AS label, p_partkey // 4 AS page FROM part WHERE p_partkey % 2 = 1),
    one AS (SELECT label, min(item_id) AS item_id FROM i GROUP BY ALL HAVING count(*) = 1),
    high AS (SELECT caption_id, item_id FROM c JOIN one USING (label)),
    free AS (SELECT page, min(item_id) AS item_id FROM i ANTI JOIN high USING (item_id) GROUP BY ALL HAVING count(*) = 1),
    first AS (SELECT page, min(caption_id) AS caption_id FROM c ANTI JOIN high USING (caption_id) GROUP BY ALL)
    SELECT caption_id, item_id, 'high' AS confidence FROM high UNION ALL SELECT caption_id, item_id, 'medium' FROM first JOIN free USING (page)"""

#: Differing bits that make two 63-bit signatures a pair.
LIMIT = 8


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of the vectors, and for every third vector a copy with up to nine bits
    turned, one in each of nine parts of the hash."""
    own = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), similarity.signature(F.col("embedding")).alias("h"))
    turned = F.array(*[F.lit(sum(1 << (7 * k + 3) for k in range(n))).cast("long") for n in range(10)])
    copies = own.filter("id % 3 = 0").select((F.col("id") + 1_000_000_000).alias("id"), F.col("h").bitwiseXOR(F.element_at(turned, (F.col("id") % 10 + 1).cast("int"))).alias("h"))
    return own.unionByName(copies)


_HASHES = "own AS (SELECT vec_id AS id, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) AS h FROM embeddings), turned AS (SELECT n, CAST(coalesce(list_sum([CAST(1 AS BIGINT) << (7 * k + 3) for k in range(n)]), 0) AS BIGINT) AS mask FROM range(10) t(n)), h AS (SELECT id, h FROM own UNION ALL SELECT id + 1000000000, xor(h, mask) FROM own JOIN turned ON n = id % 10 WHERE id % 3 = 0)"
_PAIR_SQL = f"""WITH RECURSIVE {_HASHES}, classed AS (SELECT h, min(id) AS id FROM h GROUP BY h), near AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM classed a JOIN classed b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= {LIMIT})"""
_COMPONENT_SQL = f"""{_PAIR_SQL}, both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    reach(id, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.seen = e.a)
    SELECT id, min(seen) AS component FROM reach GROUP BY id"""


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash pairs, before pairs of equal label of vectors that follow each other."""
    near = similarity.hamming_pairs(hashes(spark, sf_dir), LIMIT).select(F.col("a").alias("source"), F.col("b").alias("target"), (1 - F.col("distance") / 64).alias("score"), F.col("a").alias("seq"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    same = e.select("vec_id", "label", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("vec_id", "label", (F.col("vec_id") - F.col("k")).alias("other")).join(e.select(F.col("vec_id").alias("other"), "label"), ["other", "label"])
    return similarity.build_relationships([near, same.select(F.col("vec_id").alias("source"), F.col("other").alias("target"), F.lit(0.5).cast("double").alias("score"), F.col("vec_id").alias("seq"))])


_RELATION_SQL = f"""{_PAIR_SQL}, u AS (
        SELECT a AS source, b AS target, 1 - distance / 64 AS score, a AS seq, 0 AS pass FROM near
        UNION ALL SELECT x.vec_id, y.vec_id, 0.5, x.vec_id, 1 FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id - y.vec_id BETWEEN 1 AND 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY pass, seq, source, target) AS rn FROM u)
    SELECT least(source, target) AS a, greatest(source, target) AS b, source, target, score, pass AS priority FROM r WHERE rn = 1"""


def tile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panels = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("panel_id"), (F.col("p_size") * 9).alias("width"), (F.col("p_partkey") % 400).cast("int").alias("height"))
    return similarity.tiles(panels)


_TILE_SQL = """WITH p AS (SELECT p_partkey AS panel_id, p_size * 9 AS width, CAST(p_partkey % 400 AS INTEGER) AS height FROM part),
    t AS (SELECT panel_id, width, height, x, y FROM (SELECT *, unnest(range(0, width, 64)) AS x FROM p WHERE width >= 64 AND height >= 64), LATERAL (SELECT unnest(range(0, height, 64)) AS y))
    SELECT panel_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(least(128, width - x) AS INTEGER) AS w, CAST(least(128, height - y) AS INTEGER) AS h FROM t WHERE least(128, width - x) >= 32 AND least(128, height - y) >= 32"""

_OUTLIER_SQL = """WITH prices AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 97 = 0 THEN p_retailprice * 10 ELSE p_retailprice END AS p_retailprice FROM part), l AS (SELECT p_brand, list_sort(list(p_retailprice)) AS xs, count(*) AS n FROM prices GROUP BY ALL HAVING count(*) >= 3),
    q AS (SELECT p_brand, CASE WHEN n % 2 = 1 THEN xs[n // 2 + 1] ELSE (xs[n // 2] + xs[n // 2 + 1]) / 2 END AS median, CASE WHEN n >= 4 THEN xs[3 * n // 4 + 1] - xs[n // 4 + 1] ELSE 0.0 END AS iqr FROM l)
    SELECT p_brand, p_partkey, p_retailprice, median, iqr FROM prices JOIN q USING (p_brand) WHERE abs(p_retailprice - median) > 2 * iqr"""


def spread_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by brand; those of every 97th part are ten times as high."""
    p = read(spark, sf_dir, "part").withColumn("p_retailprice", F.when(F.col("p_partkey") % 97 == 0, F.col("p_retailprice") * 10).otherwise(F.col("p_retailprice")))
    return similarity.outliers(p, "p_brand", "p_partkey", "p_retailprice")


def scalar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over the parts table."""
    p = read(spark, sf_dir, "part").withColumn("n", (F.col("p_partkey") % 18_000 + 1).cast("int"))
    price = (F.rint(F.col("p_retailprice") * 1e6)).cast("long")
    name = scalars.index_to_col(F.col("n"))
    return p.select(
        "p_partkey",
        name.alias("col_name"),
        scalars.col_to_index(name).alias("col_index"),
        scalars.decimal_places(F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("places"),
        scalars.integer_delta(price, price + 4_000_000).alias("delta"),
        scalars.formula_pattern(F.concat(F.lit("=SUM($A$"), F.col("n").cast("string"), F.lit(",B7)"))).alias("pattern"),
        F.array_join(scalars.referenced_columns(F.concat(F.lit("=C"), F.col("n").cast("string"), F.lit("+A1*C2"))), ",").alias("refs"),
        scalars.label_key(F.concat(F.lit("Fig. "), F.col("p_brand"))).alias("label_key"),
        scalars.image_risk(F.col("p_size") / 50.0, F.element_at(F.array(F.lit("Blots"), F.lit("Flow"), F.lit("Body"), F.lit("Else")), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("risk"),
        scalars.integrity_risk(F.col("p_size") / 50.0).alias("integrity"),
        scalars.approx_equal(F.col("p_retailprice"), F.col("p_retailprice") + F.when(F.col("n") % 2 == 0, 0.01).otherwise(0.0)).alias("near"),
        scalars.shorten(F.col("p_name"), 8).alias("short"),
    )


_SCALAR_SQL = r"""WITH p AS (SELECT *, CAST(p_partkey % 18000 + 1 AS INTEGER) AS n, CAST(round_even(p_retailprice * 1e6, 0) AS BIGINT) AS v FROM part),
    k AS (SELECT *, (n - 1) % 26 + 1 AS c3, (n - ((n - 1) % 26 + 1)) // 26 AS rest FROM p),
    m AS (SELECT *, CASE WHEN rest > 0 THEN (rest - 1) % 26 + 1 ELSE 0 END AS c2 FROM k),
    f AS (SELECT *, (rest - c2) // 26 AS c1 FROM m)
    SELECT p_partkey, CASE WHEN c1 > 0 THEN chr(64 + c1::INT) ELSE '' END || CASE WHEN c2 > 0 THEN chr(64 + c2::INT) ELSE '' END || chr(64 + c3::INT) AS col_name, n AS col_index, 2 AS places,
           CASE WHEN v % 1000000 <> 0 THEN CAST(4 AS BIGINT) END AS delta, '=SUM(A<row>,B<row>)' AS pattern, 'A,C' AS refs, regexp_replace(lower('Fig. ' || p_brand), '[^a-z0-9]+', '', 'g') AS label_key,
           CASE WHEN w >= 0.7 THEN 'high' WHEN w >= 0.4 THEN 'medium' WHEN w >= 0.25 THEN 'low' ELSE 'info' END AS risk,
           CASE WHEN p_size / 50.0 >= 0.9 THEN 'high' WHEN p_size / 50.0 >= 0.7 THEN 'medium' ELSE 'low' END AS integrity,
           CASE WHEN n % 2 = 0 THEN 0.01 <= 1e-6 * (p_retailprice + 0.01) ELSE true END AS near, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 7) || '…' ELSE p_name END AS short
    FROM (SELECT *, p_size / 50.0 * [1.0, 0.2, 0.6, 0.5][p_partkey % 4 + 1] AS w FROM f)"""

def _ranges(spark, sf_dir):
    """Parts whose sizes and keys make cell ranges, column ranges, buckets and report ids."""
    letter = F.char(F.col("p_partkey") % 26 + 65)
    text = F.concat(F.lit("see "), letter, F.col("p_size").cast("string"), F.lit(":AB"), (F.col("p_size") + 9).cast("string"), F.when(F.col("p_partkey") % 2 == 0, " and B2:AA3, c1:d2").otherwise(""))
    found = scalars.cell_ranges(text)
    made = scalars.report_id("RUN", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int")), F.col("p_partkey"))
    columns = scalars.column_range(F.concat(letter, F.when(F.col("p_size") % 3 == 0, "-9").otherwise(" - e")))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.size(found).alias("n_ranges"), found[0]["first_row"].alias("first_row"), found[0]["first_col"].alias("first_col"), F.element_at(found, -1)["last_row"].alias("last_row"),
        F.element_at(found, -1)["last_col"].alias("last_col"), columns["start"].alias("from_col"), columns["end"].alias("to_col"),
        scalars.value_bucket(F.col("p_retailprice").cast("double"), 0.25).alias("bucket"), made.alias("report_id"), scalars.is_report_id(made, "RUN").alias("valid"),
    )


QUERIES = {
    "ranges_and_buckets": _ranges,
    "number_extraction": lambda s, d: text.numbers(read(s, d, "documents")),
    "number_digits": lambda s, d: text.numbers(read(s, d, "documents")).select(profile.text_terminal_digit(F.col("raw")).alias("digit"), profile.first_digit(F.col("raw")).alias("first")).groupBy("digit", "first").agg(F.count("*").alias("n")),
    "repeated_numbers": lambda s, d: text.numbers(read(s, d, "documents")).groupBy("x").agg(F.count("*").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "x").limit(50),
    "text_blocks": lambda s, d: text.blocks(read(s, d, "documents")),
    "rule_match": _matches,
    "rule_summary": lambda s, d: text.match_summary(_matches(s, d)),
    "exact_duplicates": lambda s, d: similarity.exact_groups(read(s, d, "documents"), "doc_id", "text"),
    "claim_reconciliation": claims,
    "missing_panels": missing,
    "caption_links": captions,
    "hamming_pairs": lambda s, d: similarity.hamming_pairs(hashes(s, d), LIMIT),
    "similarity_components": lambda s, d: similarity.components(similarity.hamming_pairs(hashes(s, d), LIMIT)),
    "hash_classes": lambda s, d: similarity.classes(hashes(s, d)).select("id", "class_id"),
    "relationships": relationships,
    "tiles": tile_rows,
    "texture_outliers": spread_outliers,
    "scalar_functions": scalar_rows,
}

SQL = {
    "ranges_and_buckets": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS n_ranges, p_size::INTEGER AS first_row, (p_partkey % 26 + 1)::INTEGER AS first_col,
            CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE p_size + 9 END::INTEGER AS last_row, CASE WHEN p_partkey % 2 = 0 THEN 27 ELSE 28 END::INTEGER AS last_col,
            CASE WHEN p_size % 3 <> 0 THEN (p_partkey % 26 + 1)::INTEGER END AS from_col, CASE WHEN p_size % 3 <> 0 THEN 5::INTEGER END AS to_col, round_even(p_retailprice::DOUBLE / 0.25, 0)::BIGINT AS bucket,
            'RUN-' || strftime(DATE '2020-01-01' + (p_partkey % 1000)::INTEGER, '%Y%m') || '-' || upper(substr(sha256(p_partkey::VARCHAR), 1, 6)) AS report_id, true AS valid FROM part""",
    "number_extraction": f"WITH {_NUMBERS} SELECT doc_id, line, place, raw, TRY_CAST(replace(replace(raw, ',', ''), '%', '') AS DOUBLE) AS x FROM numbers",
    "number_digits": f"WITH {_NUMBERS} SELECT regexp_extract(replace(replace(raw, ',', ''), '%', ''), '(\\d)\\D*$', 1) AS digit, regexp_extract(regexp_replace(raw, '[-+.,]', '', 'g'), '^0*([1-9])', 1) AS first, count(*) AS n FROM numbers GROUP BY ALL",
    "repeated_numbers": f"WITH {_NUMBERS}, x AS (SELECT TRY_CAST(replace(replace(raw, ',', ''), '%', '') AS DOUBLE) AS x FROM numbers) SELECT x, count(*) AS n FROM x GROUP BY x HAVING count(*) >= 3 ORDER BY n DESC, x NULLS FIRST LIMIT 50",
    "text_blocks": f"WITH {_KINDS} SELECT doc_id, CAST(block AS BIGINT) AS block, kind, min(line) AS first_line, max(line) AS last_line, count(*) AS n_lines FROM placed WHERE kind <> 'blank' GROUP BY doc_id, block, kind",
    "rule_match": f"WITH {_MATCH_SQL} SELECT doc_id, rule_id, severity, replace(substr(text, greatest(1, hit - 60), hit - greatest(1, hit - 60) + 60), chr(10), ' ') AS excerpt FROM m",
    "rule_summary": f"WITH {_MATCH_SQL} SELECT severity, count(*) AS n_matches, count(DISTINCT doc_id) AS n_documents, CASE severity WHEN 'red' THEN 'high' WHEN 'orange' THEN 'medium' ELSE 'low' END AS risk_level FROM m GROUP BY severity",
    "exact_duplicates": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY text HAVING count(*) > 1",
    "claim_reconciliation": _CLAIM_SQL,
    "missing_panels": _MISSING_SQL,
    "caption_links": _CAPTION_SQL,
    "hamming_pairs": f"{_PAIR_SQL} SELECT a, b, distance FROM near",
    "similarity_components": _COMPONENT_SQL,
    "hash_classes": f"WITH {_HASHES} SELECT id, min(id) OVER (PARTITION BY h) AS class_id FROM h",
    "relationships": _RELATION_SQL,
    "tiles": _TILE_SQL,
    "texture_outliers": _OUTLIER_SQL,
    "scalar_functions": _SCALAR_SQL,
}
