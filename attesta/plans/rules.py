"""Rules made of the benchmark's words against documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import rules as ops
from attesta.plans.sheets import read


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per item: its first two words or its third, not its fifth and sixth; every
    third rule wants its fourth word as the kind of study, every tenth is disabled."""
    item = F.col("item_id")
    words = F.split(F.regexp_replace("text", r"[^A-Za-z]+", " "), " ")
    at = lambda k: F.get(words, F.lit(k))
    keyword = lambda c: F.struct(c.alias("pattern"), F.lit("keyword").alias("type"))
    return read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("B"), item.cast("string")).alias("rule_id"), F.when(item % 2 == 0, "red").otherwise("yellow").alias("severity"), (item % 10 != 9).alias("enabled"),
        F.array(keyword(F.concat_ws(" ", at(0), at(1))), keyword(F.concat_ws(" ", at(2), at(3)))).alias("keywords"), F.array(F.concat_ws(" ", at(4), at(5))).alias("negatives"),
        F.when(item % 3 == 0, F.array(at(3))).otherwise(F.array().cast("array<string>")).alias("study_types"), F.lit("found: {excerpt}").alias("evidence_template"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.match(read(spark, sf_dir, "documents"), base(spark, sf_dir))
    return found.withColumn("excerpts", F.array_join("excerpts", " | "))


_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_SQL = f"""WITH w AS (SELECT item_id, string_split_regex(text, '[^A-Za-z]+') AS w FROM benchmark WHERE item_id % 10 <> 9),
    r AS (SELECT item_id, lower(w[1] || ' ' || w[2]) AS k1, lower(w[3] || ' ' || w[4]) AS k2, lower(w[5] || ' ' || w[6]) AS no, CASE WHEN item_id % 3 = 0 THEN lower(w[4]) ELSE '' END AS study FROM w),
    h AS (SELECT doc_id, text, r.*, strpos(lower(text), k1) AS a, strpos(lower(text), k2) AS b FROM documents, r WHERE (contains(lower(text), k1) OR contains(lower(text), k2)) AND NOT contains(lower(text), no) AND contains(lower(text), study)),
    e AS (SELECT *, CASE WHEN a > 0 THEN trim(replace(substr(text, greatest(1, a - 60), a - greatest(1, a - 60) + length(k1) + 60), chr(10), ' '), {_BLANK}) END AS x, CASE WHEN b > 0 THEN trim(replace(substr(text, greatest(1, b - 60), b - greatest(1, b - 60) + length(k2) + 60), chr(10), ' '), {_BLANK}) END AS y FROM h)
    SELECT doc_id, 'B' || item_id AS rule_id, CASE WHEN item_id % 2 = 0 THEN 'red' ELSE 'yellow' END AS severity, (a > 0)::INTEGER + (b > 0)::INTEGER AS n_hits, concat_ws(' | ', x, y) AS excerpts, 'found: ' || coalesce(x, y)[:300] AS evidence FROM e"""

QUERIES = {"rule_base": matches}
SQL = {"rule_base": _SQL}
