"""Per-column statistics and the gates that keep uninformative columns out of pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.similarity import checkpointed

COLUMN = ["workbook", "sheet", "col"]


def column_stats(cells: DataFrame, min_pairs: int = 8) -> DataFrame:
    """(workbook, sheet, col, n, distinct_values, low_info): low information means at
    least ``min_pairs`` values of which at most three, or a tenth of twenty or more, are
    distinct. Counts by value first, so a constant column is folded before it moves."""
    by_value = cells.groupBy(*COLUMN, "v").count()
    stats = by_value.groupBy(*COLUMN).agg(F.sum("count").alias("n"), F.count("*").alias("distinct_values"))
    low = (F.col("n") >= min_pairs) & ((F.col("distinct_values") <= 3) | ((F.col("n") >= 20) & (F.col("distinct_values") * 10 <= F.col("n"))))
    return stats.withColumn("low_info", low)


def informative(cells: DataFrame, min_pairs: int = 8, least: int = 3) -> DataFrame:
    """Cells of columns with at least ``least`` values that aren't low in information."""
    kept = column_stats(cells, min_pairs).filter((F.col("n") >= least) & ~F.col("low_info")).select(*COLUMN)
    return cells.join(kept, COLUMN, "left_semi")


def informative_rows(rows: DataFrame, min_pairs: int = 8, least: int = 3) -> DataFrame:
    """The same of gathered rows (workbook, sheet, row, cells); rows without such cells go."""
    cells = rows.select("workbook", "sheet", F.inline("cells"))
    kept = column_stats(cells, min_pairs).filter((F.col("n") >= least) & ~F.col("low_info")).groupBy("workbook", "sheet").agg(F.collect_set("col").alias("_kept"))
    kept = checkpointed(kept)
    met = rows.join(kept.hint("shuffle_hash"), ["workbook", "sheet"])
    return met.select("workbook", "sheet", "row", F.filter("cells", lambda c: F.array_contains("_kept", c["col"])).alias("cells")).filter(F.size("cells") > 0)


def rate(part: Column, whole: Column) -> Column:
    """A share to four places, half up."""
    return F.floor(part * 10000.0 / whole + 0.5) / 10000.0


def strength(share: Column) -> Column:
    return F.when(share >= 0.99, "complete").when(share >= 0.8, "strong").when(share >= 0.5, "moderate").otherwise("weak")
