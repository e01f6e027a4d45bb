"""File inventories, result maps, tolerant logs and artifact sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Material types by extension.
TYPES = {
    "pdf": "paper", "xlsx": "source_data", "xls": "source_data", "csv": "source_data", "tsv": "source_data",
    "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image",
    "py": "code", "r": "code", "ipynb": "code", "md": "text", "txt": "text", "json": "artifact",
}


def _files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def material_type(path: Column) -> Column:
    """Type by extension; folders named source data make unknown files source data."""
    known = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(known[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.when(F.lower(path).rlike("source.?data"), "source_data"), F.lit("other"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, size) of all files below a folder; contents aren't read."""
    return _files(spark, path).select("path", material_type(F.col("path")).alias("type"), F.col("length").alias("size"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest) of image files."""
    return _files(spark, path).filter(material_type(F.col("path")) == "image").select("path", F.sha2("content", 256).alias("digest"))


def panel_csv(spark: SparkSession, path: str, figures: DataFrame) -> DataFrame:
    """Rows of panel lists whose separator may be followed by blanks, with the figure_id of
    the figure (figure_id, path) whose file stem is their FIGNAME; others are left out."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    named = figures.groupBy(stem.alias("FIGNAME")).agg(F.max("figure_id").alias("figure_id"))
    return rows.join(named, "FIGNAME")


def result_map(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, metric, value, seq) of result CSVs, trimmed, without empty keys; ``seq``
    follows file order within a file."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.filter("dataset <> '' AND metric <> ''").select("dataset", "metric", "value", F.monotonically_increasing_id().alias("seq"))


def tolerant_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of a JSONL log; ones that don't parse are left out."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = spark.read.text(path).select(F.from_json("value", f"{schema}, _corrupt string", options).alias("r"))
    return parsed.filter("r IS NOT NULL AND r._corrupt IS NULL").select("r.*").drop("_corrupt")


def artifact(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """A table that is built once: a finished folder is read again unless ``force``."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
