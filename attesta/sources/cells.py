"""The ``cells`` relation: one row per numeric cell of a sheet.

``v`` holds the value in millionths as BIGINT (half-even at six places), so that
differences, equality and modes are exact integer work inside code generation. Values
beyond nine trillion don't fit and are left out by ``micro`` (null)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000
KEY = ("workbook", "sheet")
SCHEMA = "workbook string, sheet string, row int, col int, v long"


def micro(value: Column | str) -> Column:
    """Millionths of a number, rounded half to even."""
    return F.rint(F.col(value) * float(MICRO) if isinstance(value, str) else value * float(MICRO)).try_cast("bigint")


def unpivot(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """Cells of wide rows (workbook, sheet, row, ...): column k of the list is column k+1
    of the sheet; nulls are empty cells."""
    parts = F.array(*[F.struct(F.lit(k + 1).alias("col"), c.cast("long").alias("v")) for k, c in enumerate(columns)])
    return rows.select("workbook", "sheet", "row", F.inline(parts)).filter("v IS NOT NULL")


def packed(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """(workbook, sheet, row, cells): the cells that ``unpivot`` makes of a wide row, by
    column, as one array; rows without cells are left out."""
    parts = F.array(*[F.struct(F.lit(k + 1).alias("col"), c.cast("long").alias("v")) for k, c in enumerate(columns)])
    full = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    cells = F.when(full, parts).otherwise(F.filter(parts, lambda c: c["v"].isNotNull()))
    return rows.select("workbook", "sheet", "row", cells.alias("cells")).filter(F.size("cells") > 0)


def from_table(df: DataFrame, workbook: str, sheet: Column, order: list[str], columns: dict[str, Column]) -> DataFrame:
    """Wide rows of a table: one sheet per value of ``sheet``, rows numbered in ``order``,
    which must be total for reproducible numbers."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = sheet.cast("string")
    # A name that stands in the row isn't folded away: numbering deals rows out as ``shelf`` does.
    book = F.coalesce(F.concat(F.lit(workbook), F.substring(name, 1, 0)), F.lit(workbook))
    named = df.withColumns({"workbook": book, "sheet": name}).repartition(parts, "workbook", "sheet")
    number = F.row_number().over(Window.partitionBy("workbook", "sheet").orderBy(*order))
    return named.withColumn("row", number).select("workbook", "sheet", "row", *[c.alias(n) for n, c in columns.items()])
