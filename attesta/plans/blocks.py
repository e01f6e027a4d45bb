"""Value, block, row and profile detectors on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import blocks, fractions, profile
from attesta.operators.similarity import checkpointed
from attesta.plans import sheets
from attesta.plans.relations import _BIAS_CELLS, _TAIL_CELLS, bias_cells, planted_tails
from attesta.sources.cells import from_table, micro, unpivot

_ACCOUNTS = """base AS (SELECT 'customer' AS workbook, CAST(c_nationkey AS VARCHAR) AS sheet, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS row,
           CAST(round_even(c_acctbal * 1e6, 0) AS BIGINT) AS x, c_mktsegment AS label FROM customer)"""


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(sheets.read(spark, sf_dir, "customer"), "customer", F.col("c_nationkey"), ["c_custkey"], {"x": micro("c_acctbal"), "label": F.col("c_mktsegment")})


def ramp_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances by nation; rows 3 to 9 of column 1 rise by 1.234, rows 2 to 7 of column 2
    double; a row is left empty before the third, the eighth and the twelfth."""
    rows = _accounts(spark, sf_dir)
    up = F.when(F.col("row").between(3, 9), 7_000_123 + F.col("row") * 1_234_000).otherwise(F.col("x"))
    twice = F.when(F.col("row").between(2, 7), (F.lit(1_001_000) * F.lit(2) * F.expr("shiftleft(1L, CAST(row AS INT))"))).otherwise(F.col("x") + 77)
    gaps = sum(F.when(F.col("row") >= k, 1).otherwise(0) for k in (3, 8, 12))
    parted = rows.select("workbook", "sheet", (F.col("row") + gaps).cast("int").alias("row"), up.alias("up"), twice.alias("twice"))
    return unpivot(parted, [F.col("up"), F.col("twice")])


_RAMP = f"""{_ACCOUNTS}, kept AS (SELECT *, CAST(row + (row >= 3)::INTEGER + (row >= 8)::INTEGER + (row >= 12)::INTEGER AS INTEGER) AS place FROM base),
    cells AS (
        SELECT workbook, sheet, place AS row, 1 AS col, CASE WHEN row BETWEEN 3 AND 9 THEN 7000123 + row * 1234000 ELSE x END AS v FROM kept
        UNION ALL SELECT workbook, sheet, place, 2, CASE WHEN row BETWEEN 2 AND 7 THEN 1001000 * 2 * (CAST(1 AS BIGINT) << row) ELSE x + 77 END FROM kept)"""

_SEQUENCE_SQL = f"""WITH {_RAMP},
    n1 AS (SELECT *, row - row_number() OVER (PARTITION BY sheet, col ORDER BY row) AS g FROM cells),
    n2 AS (SELECT *, first_value(v) OVER w AS f1, nth_value(v, 2) OVER w AS f2, lag(v) OVER (PARTITION BY sheet, col, g ORDER BY row) AS before FROM n1 WINDOW w AS (PARTITION BY sheet, col, g ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    s AS (
        SELECT sheet, col, g, count(*) AS n, min(row) AS start, count(*) FILTER (v % 10000 <> 0) AS fine, max(abs(v - before - (f2 - f1))) AS off,
               max(abs(CAST(v AS DOUBLE) * f1 - CAST(before AS DOUBLE) * f2) / (abs(CAST(v AS DOUBLE) * f1) + 1)) AS crossed, max(f2 - f1) AS delta, min(abs(v)) AS least
        FROM n2 GROUP BY ALL HAVING count(*) >= 4)
    SELECT 'customer' AS workbook, sheet, CAST(col AS INTEGER) AS col, start, 'internal_sequence_relation' AS category, CASE WHEN off <= 1 THEN 'difference' ELSE 'ratio' END AS relation, n, CASE WHEN n >= 10 THEN 'high' ELSE 'medium' END AS risk_level
    FROM s WHERE fine >= 3 AND delta <> 0 AND (off <= 1 OR (least > 0 AND crossed <= 1e-9))"""


def block_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of six balances in three blocks, parted by rows 7 and 14: the second repeats
    the first with a cent more, the third is other data."""
    rows = sheets.parted(_accounts(spark, sf_dir), 6)
    own = rows.select("workbook", "sheet", "row", "x", (F.col("x") * 2).alias("y"))
    near = own.select("workbook", "sheet", (F.col("row") + 7).alias("row"), (F.col("x") + 10_000).alias("x"), (F.col("y") + 10_000).alias("y"))
    far = own.select("workbook", "sheet", (F.col("row") + 14).alias("row"), (F.col("x") * 3 + 5_000_000).alias("x"), (F.col("y") + 999_000_000).alias("y"))
    return unpivot(own.unionByName(near).unionByName(far), [F.col("x"), F.col("y")])


def _separators(cells: DataFrame) -> DataFrame:
    return cells.select("workbook", "sheet").distinct().select("workbook", "sheet", F.explode(F.array(F.lit(7), F.lit(14))).alias("row"))


_BLOCK_SQL = f"""WITH {_ACCOUNTS}, {sheets.parted_sql("base", "parts", 6)}, own AS (SELECT sheet, row, x, x * 2 AS y FROM parts),
    three AS (SELECT sheet, 0 AS block, row, x, y FROM own UNION ALL SELECT sheet, 1, row, x + 10000, y + 10000 FROM own UNION ALL SELECT sheet, 2, row, x * 3 + 5000000, y + 999000000 FROM own),
    long AS (SELECT sheet, block, row, 1 AS col, x AS v FROM three UNION ALL SELECT sheet, block, row, 2, y FROM three),
    sized AS (SELECT sheet, block, count(DISTINCT row) AS size FROM long GROUP BY ALL HAVING count(DISTINCT row) >= 3),
    s AS (
        SELECT a.sheet, a.block AS p, b.block AS q, a.col, count(*) AS n, count(DISTINCT a.v) AS kinds, max(abs(b.v - a.v)) AS md, min(abs(b.v - a.v)) AS ld, sum(abs(a.v) + abs(b.v)) AS mag, least(min(abs(a.v)), min(abs(b.v))) AS la, greatest(max(abs(a.v)), max(abs(b.v))) AS ha
        FROM long a JOIN long b ON a.sheet = b.sheet AND a.col = b.col AND a.row = b.row AND a.block < b.block JOIN sized ON sized.sheet = a.sheet AND sized.block = a.block GROUP BY ALL)
    SELECT 'customer' AS workbook, sheet, CAST(col AS INTEGER) AS col, CAST(p AS BIGINT) AS block_x, CAST(q AS BIGINT) AS block_y, 'cross_block_paired_diff_too_narrow' AS category, shared AS n_columns, n AS n_rows, CASE WHEN n >= 10 THEN 'high' ELSE 'medium' END AS risk_level
    FROM (SELECT *, count(*) OVER (PARTITION BY sheet, p, q) AS shared FROM s)
    WHERE shared >= 2 AND (md * 40 * n < mag OR ((md - ld) * 100 < ha - la AND md * 100 < ha - la)) AND NOT (n >= 8 AND (kinds <= 3 OR (n >= 20 AND kinds * 10 <= n)))"""

_LOW = "SELECT sheet, col FROM cells GROUP BY ALL HAVING count(*) >= 8 AND (count(DISTINCT v) <= 3 OR (count(*) >= 20 AND count(DISTINCT v) * 10 <= count(*)))"


def group_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, discount and tax of supplier sheets, sixty rows each."""
    rows = sheets.parted(sheets._lines(spark, sf_dir), 60)
    return unpivot(rows, [F.col("q"), F.col("d"), F.col("t")])


_GROUP = f"{sheets._LINES_SQL}, {sheets.parted_sql('lines', 'parts', 60)}, cells AS ({sheets._union(['q', 'd', 't'], 'parts')})"

_EVENT, _ZERO = "(right(sheet, 1) = '3' AND max(days) > 0)", "(count(*) >= 20 AND max(zeros) >= 2)"
_ROWS_SQL = f"""WITH {_GROUP}, low AS ({_LOW}),
    vec AS (SELECT sheet, row, list((col, v) ORDER BY col) AS vector, count(*) FILTER (v = 0) AS zeros, count(*) FILTER (col = 3) AS days, count(*) FILTER (NOT EXISTS (SELECT 1 FROM low WHERE low.sheet = c.sheet AND low.col = c.col)) AS known FROM cells c GROUP BY sheet, row)
    SELECT 'lineitem' AS workbook, sheet, min(row) AS first_row, 'duplicate_row_vector' AS category, count(*) AS n, CAST(max(len(vector)) AS INTEGER) AS width,
           CASE WHEN {_EVENT} THEN 'low' WHEN {_ZERO} OR count(*) < 4 THEN 'medium' ELSE 'high' END AS risk_level, CASE WHEN {_EVENT} OR {_ZERO} THEN 'high' ELSE 'unknown' END AS artifact_likelihood
    FROM vec WHERE len(vector) >= 2 AND known > 0 GROUP BY sheet, vector HAVING count(*) >= 2"""

_PROFILE_ROWS_SQL = f"""WITH {sheets.SMALL_SQL},
    vec AS (SELECT sheet, row, string_agg(CAST(v AS VARCHAR), ',' ORDER BY col) AS vector FROM cells GROUP BY ALL HAVING count(*) >= 3),
    g AS (SELECT sheet, vector, count(*) AS n, min(row) AS first_row FROM vec GROUP BY ALL HAVING count(*) >= 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sheet ORDER BY n DESC, first_row) AS INTEGER) AS rank FROM g)
    SELECT 'lineitem' AS workbook, * FROM r WHERE rank <= 20"""


def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, discount and tax of each line as a fingerprint; groups are return flags."""
    df = sheets.read(spark, sf_dir, "lineitem")
    rows = from_table(df, "lineitem", F.col("l_suppkey"), sheets.LINE_ORDER, {"grp": F.col("l_returnflag"), "q": micro("l_quantity"), "d": micro("l_discount"), "t": micro("l_tax")})
    return rows.withColumn("fingerprint", F.concat_ws("|", F.col("q").cast("string"), F.col("d").cast("string"), F.col("t").cast("string")))


_REUSE_SQL = f"""WITH rows AS (
        SELECT CAST(l_suppkey AS VARCHAR) AS sheet, l_returnflag AS grp, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(sheets.LINE_ORDER)}) AS INTEGER) AS row,
               concat_ws('|', CAST(CAST(round_even(l_quantity * 1e6, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(l_discount * 1e6, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(l_tax * 1e6, 0) AS BIGINT) AS VARCHAR)) AS fingerprint FROM lineitem),
    l AS (SELECT sheet, grp, fingerprint, max(row) AS left_row FROM rows GROUP BY ALL)
    SELECT 'lineitem' AS workbook, l.sheet, l.grp AS left_group, r.grp AS right_group, left_row, r.row AS right_row, l.fingerprint FROM l JOIN rows r ON l.sheet = r.sheet AND l.fingerprint = r.fingerprint AND l.grp < r.grp"""


def compare_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of ten balances, of which rows 11 to 20 repeat rows 1 to 10: plus five, times three, plus
    two except one row, and as they are."""
    rows = sheets.parted(_accounts(spark, sf_dir), 10)
    x = F.col("x")
    one = unpivot(rows, [x, x, x, x])
    two = unpivot(rows.withColumn("row", F.col("row") + 10), [x + 5_000_000, x * 3, x + F.when(F.col("row") == 14, 1).otherwise(2_000_000), F.col("x") * F.when(F.col("row") > 15, 2).otherwise(1)])
    return one.unionByName(two)


_COMPARE_SQL = f"""WITH {_ACCOUNTS}, {sheets.parted_sql("base", "parts", 10)}, own AS (SELECT sheet, row, x FROM parts),
    met AS (
        SELECT sheet, 1 AS col, row, x AS a, x + 5000000 AS b FROM own UNION ALL SELECT sheet, 2, row, x, x * 3 FROM own
        UNION ALL SELECT sheet, 3, row, x, x + CASE WHEN row = 4 THEN 1 ELSE 2000000 END FROM own UNION ALL SELECT sheet, 4, row, x, x * CASE WHEN row > 5 THEN 2 ELSE 1 END FROM own),
    k AS (SELECT *, b - a AS d, CASE WHEN a <> 0 THEN CAST(round_even(b * 1e6 / a, 0) AS BIGINT) END AS r FROM met),
    s AS (SELECT sheet, col, count(*) AS n, min(d) AS d0, max(d) AS d1, min(r) AS r0, max(r) AS r1, count(r) AS nr, count(*) FILTER (d = 0) AS exact FROM k GROUP BY ALL),
    m AS (SELECT sheet, col, max(c) AS top FROM (SELECT sheet, col, d, count(*) AS c FROM k GROUP BY ALL) GROUP BY ALL),
    p AS (SELECT *, CASE WHEN n > 1 AND d0 = d1 THEN 'fixed_difference' WHEN n > 1 AND nr = n AND r0 = r1 THEN 'fixed_ratio' WHEN n > 2 AND top * 10 >= n * 9 THEN 'near_fixed_difference' ELSE 'none' END AS pattern FROM s JOIN m USING (sheet, col))
    SELECT 'customer' AS workbook, sheet, CAST(col AS INTEGER) AS col, n, pattern, CASE WHEN pattern = 'none' THEN exact ELSE 0 END AS exact_matches FROM p"""

_POSITION_SQL = f"""WITH {sheets.SUPPLIER_SQL},
    placed AS (SELECT *, row_number() OVER (PARTITION BY sheet, col ORDER BY row) AS place, count(*) OVER (PARTITION BY sheet, col) AS n FROM cells),
    met AS (SELECT a.sheet, a.col AS l, b.col AS r, a.n, a.place, a.v AS a, b.v AS b FROM placed a JOIN placed b ON a.sheet = b.sheet AND a.place = b.place AND a.n = b.n AND a.col < b.col WHERE a.n >= 8),
    keyed AS (SELECT sheet, l, r, n, place, 'difference' AS kind, CAST(round_even((b - a) / 100.0, 0) AS BIGINT) AS k FROM met UNION ALL SELECT sheet, l, r, n, place, 'ratio', CAST(round_even(b * 1e4 / CAST(a AS DOUBLE), 0) AS BIGINT) FROM met WHERE a <> 0),
    modes AS (SELECT *, row_number() OVER (PARTITION BY sheet, l, r, kind ORDER BY support DESC, first) AS rn FROM (SELECT sheet, l, r, kind, n, k, count(*) AS support, min(place) AS first FROM keyed GROUP BY ALL))
    SELECT 'lineitem' AS workbook, sheet, l AS "left", r AS "right", kind, k AS value, support, n FROM modes WHERE rn = 1 AND support * 100 >= n * 80"""

_FRACTION = "abs(v) % 1000000"
_REPEATED_SQL = f"""WITH {_BIAS_CELLS},
    placed AS (SELECT *, CASE WHEN {_FRACTION} = 0 THEN 0 ELSE 6 - length(regexp_extract(CAST({_FRACTION} AS VARCHAR), '(0*)$', 1)) END AS places FROM cells WHERE v NOT IN (0, 1000000, -1000000)),
    g AS (SELECT sheet, v, count(*) AS n, CAST(max(places) AS INTEGER) AS places, count(DISTINCT row) AS nr FROM placed GROUP BY ALL)
    SELECT 'events' AS workbook, sheet, v AS value, 'repeated_measurement_value' AS category, n, places,
           CASE WHEN n >= 3 THEN CASE WHEN places >= 5 THEN 'high' ELSE 'medium' END WHEN nr > 1 AND places < 5 THEN 'low' ELSE 'medium' END AS risk_level, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS confidence
    FROM g WHERE (n >= 3 AND places >= 3) OR (n = 2 AND places >= 4)"""
_TAILED = """tailed AS (SELECT *, CAST(CASE WHEN abs(v) % 10 = 0 THEN (abs(v) % 1000000) // 10 ELSE abs(v) % 100000 END AS INTEGER) AS tail FROM cells WHERE abs(v) % 10 <> 0 OR (abs(v) // 10) % 10 <> 0)"""
_TAIL_REUSE_SQL = f"""WITH {_TAIL_CELLS}, {_TAILED}
    SELECT 'orders' AS workbook, sheet, tail, 'fractional_tail_reuse' AS category, count(*) AS n, count(DISTINCT v) AS distinct_values, CASE WHEN count(*) >= 5 THEN 'high' ELSE 'medium' END AS risk_level
    FROM tailed WHERE tail <> 0 GROUP BY sheet, tail HAVING count(*) >= 3 AND count(DISTINCT v) >= 2"""


def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rows of six-place decimals, and shifted copies of every hundredth."""
    e = sheets.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    v = F.rint(F.col("x").cast("double") * 1e6).cast("long")
    place = [(F.col("vec_id") + 1).cast("int").alias("row"), (F.col("k") + 1).cast("int").alias("col")]
    own = e.select(F.lit("embeddings").alias("workbook"), F.lit("a").alias("sheet"), *place, v.alias("v"))
    copy = own.filter("row % 100 = 1").withColumns({"sheet": F.lit("b"), "v": F.when(F.col("v") < 0, F.col("v") - 3_000_000).otherwise(F.col("v") + 3_000_000)})
    return own.unionByName(copy)


_CROSS_TAIL_SQL = f"""WITH own AS (
        SELECT 'a' AS sheet, CAST(vec_id + 1 AS INTEGER) AS row, CAST(k AS INTEGER) AS col, CAST(round_even(CAST(embedding[k] AS DOUBLE) * 1e6, 0) AS BIGINT) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k) WHERE embedding[k] IS NOT NULL),
    cells AS (SELECT * FROM own UNION ALL SELECT 'b', row, col, CASE WHEN v < 0 THEN v - 3000000 ELSE v + 3000000 END FROM own WHERE row % 100 = 1), {_TAILED},
    num AS (SELECT sheet, row, tail, v, row_number() OVER (PARTITION BY sheet, row ORDER BY col) AS ord, count(*) OVER (PARTITION BY sheet, row) AS width FROM tailed WHERE tail <> 0),
    met AS (SELECT a.sheet AS sx, a.row AS rx, b.sheet AS sy, b.row AS ry, a.ord AS o, a.ord - b.ord AS off FROM num a JOIN num b ON a.tail = b.tail AND (a.sheet, a.row) < (b.sheet, b.row) AND a.v <> b.v WHERE a.width >= 4 AND b.width >= 4),
    isl AS (SELECT *, o - row_number() OVER (PARTITION BY sx, rx, sy, ry, off ORDER BY o) AS g FROM met),
    runs AS (SELECT sx, rx, sy, ry, max(n) AS support FROM (SELECT sx, rx, sy, ry, off, g, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL HAVING max(n) >= 4)
    SELECT 'embeddings' AS workbook, sx AS sheet_x, rx AS row_x, sy AS sheet_y, ry AS row_y, 'cross_sheet_fractional_tail_reuse' AS category, support, CASE WHEN support >= 5 AND rx = ry THEN 'high' ELSE 'medium' END AS risk_level, CASE WHEN support >= 5 THEN 'high' ELSE 'medium' END AS confidence FROM runs"""


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    return sheets.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", price.alias("raw"))


_DIGIT_SQL = r"""WITH d AS (SELECT l_returnflag, l_linestatus, regexp_extract(CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS VARCHAR), '(\d)(?:\.0+)?$', 1) AS digit FROM lineitem),
    c AS (SELECT l_returnflag, l_linestatus, digit, count(*) AS n FROM d WHERE digit <> '' GROUP BY ALL)
    SELECT *, CAST(sum(n) OVER w AS BIGINT) AS total, CAST(sum(CASE WHEN digit IN ('0', '5') THEN n ELSE 0 END) OVER w AS BIGINT) AS zero_or_five FROM c WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)"""

_BENFORD_SQL = """WITH x AS (SELECT abs(l_extendedprice) AS x FROM lineitem WHERE abs(l_extendedprice) > 0 AND abs(l_extendedprice) < 1e12),
    d AS (SELECT CAST(floor(x / pow(10.0, floor(log10(x))) + 1e-9) AS INTEGER) AS digit, CAST(floor(log10(x)) AS INTEGER) AS o FROM x),
    t AS (SELECT count(*) AS total, max(o) - min(o) AS orders FROM d),
    s AS (SELECT CAST(k AS INTEGER) AS digit, (SELECT count(*) FROM d WHERE d.digit = k) AS n, total, orders FROM t, (SELECT unnest(range(1, 10)) AS k))
    SELECT digit, n, total, n::DOUBLE / total AS observed, log10(1 + 1.0 / digit) AS expected, sum(abs(n::DOUBLE / total - log10(1 + 1.0 / digit))) OVER () / 9 AS mad, total >= 100 AND orders >= 2 AS applicable FROM s"""

_ROLLUP_SQL = f"""WITH {sheets.SUPPLIER_SQL}
    SELECT workbook, sheet, CAST(grouping_id(workbook, sheet) AS INTEGER) AS level, count(*) AS cells, count(DISTINCT col) AS columns, count(*) FILTER (v % 1000000 = 0) AS whole FROM cells GROUP BY ROLLUP (workbook, sheet)"""

_TOP_SQL = f"""WITH {sheets.SUPPLIER_SQL}, c AS (SELECT sheet, v, count(*) AS n FROM cells GROUP BY ALL HAVING count(*) > 1),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sheet ORDER BY n DESC, v) AS INTEGER) AS rank FROM c)
    SELECT 'lineitem' AS workbook, * FROM r WHERE rank <= 30"""

def _positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    with sheets.kept_supplier(spark, sf_dir) as (cells, _):
        return checkpointed(blocks.positional_relations(cells))


QUERIES = {
    "internal_sequence": lambda s, d: blocks.sequences(ramp_cells(s, d), formulas=sheets.planted_known(ramp_cells(s, d))["formulas"]),
    "cross_block_diff": lambda s, d: blocks.cross_blocks(block_cells(s, d), _separators(block_cells(s, d))),
    "duplicate_rows": lambda s, d: blocks.duplicate_rows(group_cells(s, d), labels=sheets.planted_known(group_cells(s, d))["labels"]),
    "profile_duplicate_rows": lambda s, d: blocks.profile_duplicate_rows(sheets.small_cells(s, d)),
    "cross_group_reuse": lambda s, d: blocks.cross_group_reuse(group_rows(s, d)),
    "compare_groups": lambda s, d: blocks.compare_groups(compare_cells(s, d), (1, 10), (11, 20)),
    "extract_block": lambda s, d: blocks.extract_block(sheets.supplier_cells(s, d), (2, 15), (2, 5)),
    "table_relationships": _positional,
    "repeated_values": lambda s, d: fractions.repeated_values(bias_cells(s, d)),
    "tail_reuse": lambda s, d: fractions.tail_reuse(planted_tails(s, d)),
    "cross_sheet_tails": lambda s, d: fractions.cross_sheet_tails(tail_rows(s, d)),
    "terminal_digits": lambda s, d: profile.digit_histogram(_prices(s, d), ["l_returnflag", "l_linestatus"]),
    "benford": lambda s, d: profile.benford(sheets.read(s, d, "lineitem"), "l_extendedprice"),
    "profile_rollup": lambda s, d: profile.summary(sheets.supplier_cells(s, d)),
    "repeated_top": lambda s, d: profile.repeated_top(sheets.supplier_cells(s, d)),
}

SQL = {
    "internal_sequence": sheets.gated_sql(_SEQUENCE_SQL, ["col"], high=("formula",)),
    "cross_block_diff": _BLOCK_SQL,
    "duplicate_rows": _ROWS_SQL,
    "profile_duplicate_rows": _PROFILE_ROWS_SQL,
    "cross_group_reuse": _REUSE_SQL,
    "compare_groups": _COMPARE_SQL,
    "extract_block": f"WITH {sheets.SUPPLIER_SQL} SELECT workbook, sheet, row, CAST(col AS INTEGER) AS col, v / 1000000.0 AS value FROM cells WHERE row BETWEEN 2 AND 15 AND col BETWEEN 2 AND 5",
    "table_relationships": _POSITION_SQL,
    "repeated_values": _REPEATED_SQL,
    "tail_reuse": _TAIL_REUSE_SQL,
    "cross_sheet_tails": _CROSS_TAIL_SQL,
    "terminal_digits": _DIGIT_SQL,
    "benford": _BENFORD_SQL,
    "profile_rollup": _ROLLUP_SQL,
    "repeated_top": _TOP_SQL,
}
