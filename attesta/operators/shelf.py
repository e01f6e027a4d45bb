"""Tables that an operator reads several times, kept in the shared folder while it runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from attesta.operators.similarity import checkpoint_dir

SHEET = ("workbook", "sheet")


@contextmanager
def shelf(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Gives a function that writes a table (workbook, sheet, ...) as compressed columns,
    bucketed by sheet, and reads it from there: what groups or joins by sheet afterwards
    exchanges none of its rows. The tables go with the block, so what is returned from it
    must not read them."""
    names: list[str] = []
    folder = f"{checkpoint_dir(spark)}/shelf-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        names.append(f"kept_{uuid.uuid4().hex}")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Rows that come dealt by sheet into as many parts aren't exchanged again.
        dealt = df.repartition(parts, *SHEET)
        dealt.write.bucketBy(parts, *SHEET).option("path", f"{folder}/{names[-1]}").saveAsTable(names[-1])
        return spark.table(names[-1])

    try:
        yield keep
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
