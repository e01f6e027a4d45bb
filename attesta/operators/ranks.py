"""Places in an order, without a task that holds all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.similarity import checkpointed


def placed(rows: DataFrame, order: list[Column | str], within: list[str] | None = None, name: str = "place") -> DataFrame:
    """``rows`` with their places from one on in ``order`` among those of equal ``within``
    columns (nulls are one group), as a long.

    The rows are range-partitioned in that order and counted per partition, and a partition
    goes on where the ones before it stopped: what is ordered by a window is one row per
    group and partition. Rows that are equal in the whole order may change places between
    runs, so it should be total."""
    within = within or []
    full = [*map(F.col, within), *[F.col(o) if isinstance(o, str) else o for o in order]]
    put = checkpointed(rows.repartitionByRange(*full).sortWithinPartitions(*full).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = put.groupBy(*within, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    keys = within or [F.lit(0)]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    starts = parts.select(*[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)], F.col("_part").alias("_p"), shift.alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{k}"))
    return put.join(starts, same).select(*[put[c] for c in rows.columns], (F.col("_at") + F.col("_shift")).alias(name))


def padded(number: Column, digits: int) -> Column:
    """A number with leading zeros; one with more digits keeps them all."""
    text = number.cast("string")
    return F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)
