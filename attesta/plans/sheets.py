"""The driver's tables as sheets of cells, in Spark and as SQL.

A table is a workbook, a key its sheet, and rows are numbered by a total order. Companion
columns plant what the detectors look for; they are integer arithmetic on both sides."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.operators.shelf import shelf
from attesta.sources.cells import from_table, micro, packed, unpivot

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over as many parts as an exchange has, before they are made much larger."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def parted(rows: DataFrame, size: int) -> DataFrame:
    """Sheets cut into sheets of ``size`` rows each, numbered from one."""
    part = F.floor((F.col("row") - 1) / size).cast("string")
    return rows.withColumns({"sheet": F.concat_ws("/", "sheet", part), "row": ((F.col("row") - 1) % size + 1).cast("int")})


def parted_sql(source: str, name: str, size: int) -> str:
    return f"{name} AS (SELECT * REPLACE (sheet || '/' || CAST((row - 1) // {size} AS VARCHAR) AS sheet, CAST((row - 1) % {size} + 1 AS INTEGER) AS row) FROM {source})"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"q": micro("l_quantity"), "p": micro("l_extendedprice"), "d": micro("l_discount"), "t": micro("l_tax")}
    return from_table(read(spark, sf_dir, "lineitem"), "lineitem", F.col("l_suppkey"), LINE_ORDER, columns)


_LINES_SQL = f"""lines AS (
    SELECT 'lineitem' AS workbook, CAST(l_suppkey AS VARCHAR) AS sheet,
           CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(LINE_ORDER)}) AS INTEGER) AS row,
           CAST(round_even(l_quantity * 1e6, 0) AS BIGINT) AS q, CAST(round_even(l_extendedprice * 1e6, 0) AS BIGINT) AS p,
           CAST(round_even(l_discount * 1e6, 0) AS BIGINT) AS d, CAST(round_even(l_tax * 1e6, 0) AS BIGINT) AS t
    FROM lineitem)"""


def _supplier_columns() -> list[Column]:
    q, p = F.col("q"), F.col("p")
    return [q, p, q, p + 3_500_000, p * 2, p * 2 + 300_000, p + 10_000, F.col("d")]


def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, price, a copy of quantity, price + 3.5, price * 2, price * 2 + 0.3,
    price + 0.01 and discount, by supplier."""
    return unpivot(_lines(spark, sf_dir), _supplier_columns())


@contextmanager
def kept(wide: DataFrame, columns: list[Column]) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The cells of wide rows, and the same gathered by row: both are made from one table of
    the wide rows, which is kept while the block runs."""
    with shelf(wide.sparkSession) as keep:
        table = keep(wide)
        yield unpivot(table, columns), packed(table, columns)


def kept_supplier(spark: SparkSession, sf_dir: str) -> AbstractContextManager[tuple[DataFrame, DataFrame]]:
    """``supplier_cells`` and their gathered rows."""
    return kept(_lines(spark, sf_dir), _supplier_columns())


def _union(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT workbook, sheet, row, {k + 1} AS col, {c} AS v FROM {source} WHERE {c} IS NOT NULL" for k, c in enumerate(columns))


SUPPLIER_SQL = f"{_LINES_SQL}, cells AS ({_union(['q', 'p', 'q', 'p + 3500000', 'p * 2', 'p * 2 + 300000', 'p + 10000', 'd'], 'lines')})"
PAIRS_SQL = """pairs AS (
    SELECT a.workbook, a.sheet, a.row, a.col AS l, b.col AS r, a.v AS a, b.v AS b
    FROM cells a JOIN cells b ON a.workbook = b.workbook AND a.sheet = b.sheet AND a.row = b.row AND a.col < b.col)"""


#: Labels of the supplier sheets' columns: (column, label, divisor, label of the suppliers
#: whose key the divisor divides).
LABELS = [
    (1, "quantity", 2, "N total"), (2, "Mean price", None, None), (3, "quantity again", 5, "day quantity"), (4, "price plus", None, None),
    (5, "Sum of prices", None, None), (6, "line", None, None), (7, "price cent", None, None), (8, "rebate", None, None),
]


def supplier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    label = lambda name, every, other: F.when(key % every == 0, other).otherwise(name) if every else F.lit(name)
    named = F.array(*[F.struct(F.lit(col).alias("col"), label(*rest).alias("label")) for col, *rest in LABELS])
    return read(spark, sf_dir, "supplier").select(F.lit("lineitem").alias("workbook"), key.cast("string").alias("sheet"), F.inline(named))


def supplier_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column 6 is a formula in the sheets of every seventh supplier."""
    return read(spark, sf_dir, "supplier").filter("s_suppkey % 7 = 0").select(F.lit("lineitem").alias("workbook"), F.col("s_suppkey").cast("string").alias("sheet"), F.lit(6).alias("col"))


def known(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What is known of the supplier sheets besides their cells."""
    return {"labels": supplier_labels(spark, sf_dir), "formulas": supplier_formulas(spark, sf_dir)}


KNOWN_SQL = """labs AS (""" + " UNION ALL ".join(
    f"SELECT CAST(s_suppkey AS VARCHAR) AS sheet, {col} AS col, " + (f"CASE WHEN s_suppkey % {every} = 0 THEN '{other}' ELSE '{name}' END" if every else f"'{name}'") + " AS label FROM supplier"
    for col, name, every, other in LABELS
) + """), formulas AS (SELECT CAST(s_suppkey AS VARCHAR) AS sheet, 6 AS col FROM supplier WHERE s_suppkey % 7 = 0)"""


def _unit_columns() -> list[Column]:
    q, unit = F.col("q"), F.rint(F.col("p") * 1e6 / F.col("q")).cast("long")
    return [q, unit, F.rint(q * unit.cast("double") / 1e6).cast("long"), F.col("t")]


def unit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, unit price, quantity times unit price, and tax, by supplier."""
    return unpivot(_lines(spark, sf_dir), _unit_columns())


def kept_unit(spark: SparkSession, sf_dir: str) -> AbstractContextManager[tuple[DataFrame, DataFrame]]:
    """``unit_cells`` and their gathered rows."""
    return kept(_lines(spark, sf_dir), _unit_columns())


UNIT_SQL = f"""{_LINES_SQL}, units AS (SELECT *, CAST(round_even(p * 1e6 / q, 0) AS BIGINT) AS u FROM lines),
    cells AS ({_union(['q', 'u', 'CAST(round_even(q * CAST(u AS DOUBLE) / 1e6, 0) AS BIGINT)', 't'], 'units')})"""


def small_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, discount and tax, by supplier."""
    return unpivot(_lines(spark, sf_dir), [F.col("q"), F.col("d"), F.col("t")])


SMALL_SQL = f"{_LINES_SQL}, cells AS ({_union(['q', 'd', 't'], 'lines')})"


def copied_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by supplier, and a second workbook that repeats every tenth of these sheets
    with every ninth value raised by one."""
    rows = _lines(spark, sf_dir)
    own = unpivot(rows, [F.col("p")])
    copy = rows.filter(F.col("sheet").cast("int") % 10 == 0).withColumns({"workbook": F.lit("copy"), "p": F.col("p") + F.when(F.col("row") % 9 == 0, 1_000_000).otherwise(0)})
    return own.unionByName(unpivot(copy, [F.col("p")]))


COPIED_SQL = f"""{_LINES_SQL}, copies AS (SELECT 'copy' AS workbook, sheet, row, p + CASE WHEN row % 9 = 0 THEN 1000000 ELSE 0 END AS p FROM lines WHERE CAST(sheet AS INTEGER) % 10 = 0),
    cells AS ({_union(['p'], 'lines')} UNION ALL {_union(['p'], 'copies')})"""


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total price, price + 7 except on every tenth row, and the price one row before, for
    the orders of every customer group of ten."""
    columns = {"p": micro("o_totalprice")}
    rows = from_table(read(spark, sf_dir, "orders"), "orders", F.floor(F.col("o_custkey") / 10), ["o_orderkey"], columns)
    before = F.lag("p").over(Window.partitionBy("sheet").orderBy("row"))
    return unpivot(rows.withColumn("before", before), [F.col("p"), F.col("p") + F.when(F.col("row") % 10 == 0, 7_100_000).otherwise(7_000_000), F.col("before")])


ORDER_SQL = f"""base AS (
    SELECT 'orders' AS workbook, CAST(o_custkey // 10 AS VARCHAR) AS sheet, CAST(row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderkey) AS INTEGER) AS row,
           CAST(round_even(o_totalprice * 1e6, 0) AS BIGINT) AS p FROM orders),
    shifted AS (SELECT *, lag(p) OVER (PARTITION BY sheet ORDER BY row) AS before FROM base),
    cells AS ({_union(['p', 'p + CASE WHEN row % 10 = 0 THEN 7100000 ELSE 7000000 END', 'before'], 'shifted')})"""


def event_cells(spark: SparkSession, sf_dir: str, factor: int = 2) -> DataFrame:
    """Event values by user; in every second ten rows, column 1 repeats the value of ten
    rows before times two; column 2 is column 1 times the row's last digit plus two."""
    rows = from_table(read(spark, sf_dir, "events"), "events", F.col("user_id"), ["ts", "event_id"], {"x": micro("value")})
    past = F.lag("x", 10).over(Window.partitionBy("sheet").orderBy("row"))
    v = F.when(F.floor((F.col("row") - 1) / 10) % 2 == 1, past * factor).otherwise(F.col("x"))
    rows = rows.withColumn("v1", v)
    return unpivot(rows, [F.col("v1"), F.col("v1") * (F.col("row") % 10 + 2)])


EVENT_SQL = f"""base AS (
    SELECT 'events' AS workbook, CAST(user_id AS VARCHAR) AS sheet, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS row,
           CAST(round_even(value * 1e6, 0) AS BIGINT) AS x FROM events),
    shifted AS (SELECT *, CASE WHEN (row - 1) // 10 % 2 = 1 THEN lag(x, 10) OVER (PARTITION BY sheet ORDER BY row) * 2 ELSE x END AS v1 FROM base),
    cells AS ({_union(['v1', 'v1 * (row % 10 + 2)'], 'shifted')})"""


def offset_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values by user that repeat every 13 to 32 rows, doubled each time but for
    every third user; column 2 is column 1 times the place in the period plus two."""
    rows = from_table(read(spark, sf_dir, "events"), "events", F.col("user_id"), ["ts", "event_id"], {"user": F.col("user_id"), "x": micro("value")})
    rows = rows.withColumn("period", (13 + F.col("user") % 20).cast("int"))
    phase = (F.col("row") - 1) % F.col("period")
    first = F.first("x").over(Window.partitionBy("sheet", phase).orderBy("row"))
    times = F.when(F.col("user") % 3 == 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, CAST((row - 1) DIV period AS INT))"))
    rows = rows.withColumn("v1", first * times)
    return unpivot(rows, [F.col("v1"), F.col("v1") * (phase + 2)])


OFFSET_SQL = f"""base AS (
    SELECT 'events' AS workbook, CAST(user_id AS VARCHAR) AS sheet, user_id, 13 + user_id % 20 AS period, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS row,
           CAST(round_even(value * 1e6, 0) AS BIGINT) AS x FROM events),
    periods AS (SELECT *, first_value(x) OVER (PARTITION BY sheet, (row - 1) % period ORDER BY row) * CASE WHEN user_id % 3 = 0 THEN 1 ELSE CAST(1 AS BIGINT) << ((row - 1) // period) END AS v1 FROM base),
    cells AS ({_union(['v1', 'v1 * ((row - 1) % period + 2)'], 'periods')})"""


#: What is planted besides numbers where a sheet has no labels of its own: the first two
#: columns are ``pre`` and ``post`` in sheets whose name ends in an even digit, the third is
#: a ``day`` in those that end in 3, and the second is a formula in those that end in 7.
EVEN = ("0", "2", "4", "6", "8")


def planted_known(cells: DataFrame) -> dict[str, DataFrame]:
    """Labels and formula columns of the sheets of ``cells`` by the rule above."""
    last = F.substring("sheet", -1, 1)
    columns = cells.select("workbook", "sheet", "col").distinct()
    label = F.when(last.isin(*EVEN) & (F.col("col") == 1), "pre").when(last.isin(*EVEN) & (F.col("col") == 2), "post").when((last == "3") & (F.col("col") == 3), "day")
    named = columns.withColumn("label", F.coalesce(label, F.concat(F.lit("series "), F.col("col").cast("string"))))
    return {"labels": named, "formulas": columns.filter((last == "7") & (F.col("col") == 2))}


PLANTED_SQL = """labs AS (
        SELECT DISTINCT sheet, col, CASE WHEN right(sheet, 1) IN ('0', '2', '4', '6', '8') AND col = 1 THEN 'pre' WHEN right(sheet, 1) IN ('0', '2', '4', '6', '8') AND col = 2 THEN 'post'
               WHEN right(sheet, 1) = '3' AND col = 3 THEN 'day' ELSE 'series ' || CAST(col AS VARCHAR) END AS label FROM cells),
    formulas AS (SELECT DISTINCT sheet, col FROM cells WHERE right(sheet, 1) = '7' AND col = 2)"""


def gated_sql(sql: str, columns: list[str], low: tuple[str, ...] = ("formula",), high: tuple[str, ...] = ("semantic",)) -> str:
    """``sql`` with the planted labels and formulas applied: the risk is low for the reasons
    in ``low``, artifact_likelihood high for those in ``high``."""
    both = " AND ".join(f"{k} IN ({', '.join(columns)})" for k in (1, 2))
    reasons = {"formula": f"(right(sheet, 1) = '7' AND 2 IN ({', '.join(columns)}))", "semantic": f"(right(sheet, 1) IN ('0', '2', '4', '6', '8') AND {both})"}
    found = {name: " OR ".join(reasons[r] for r in chosen) or "false" for name, chosen in (("low", low), ("high", high))}
    return f"SELECT * REPLACE (CASE WHEN {found['low']} THEN 'low' ELSE risk_level END AS risk_level), CASE WHEN {found['high']} THEN 'high' ELSE 'unknown' END AS artifact_likelihood FROM ({sql})"
