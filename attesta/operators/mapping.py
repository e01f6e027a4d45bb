"""From sheets to figures to paragraphs, from comments to findings, and review state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.scalars import clean_space, figure_key, sentences

#: Claims that are compared with every finding at most.
MAX_CLAIMS = 10_000
FIGURE_REFERENCE = r"(?i)(?:fig(?:ure|\.)?)\s*(\d+)\s*([a-z]?)\b"


def claim_mappings(sheets: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", refs: int = 6, least: int = 30) -> DataFrame:
    """(sheet, number, id, sentence, place): sentences that refer to the figure that a
    sheet is named for; up to ``refs`` per sheet, in text order, ones that begin alike for
    180 characters once. Figure numbers are extracted on both sides, so sheets and
    sentences meet in an equi-join instead of a regex per pair."""
    keys = sheets.select("sheet", figure_key(F.col("sheet")).alias("k")).filter("k IS NOT NULL").select("sheet", F.col("k.number").alias("number"))
    said = docs.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("place", "sentence"))
    said = said.withColumn("sentence", clean_space(F.col("sentence"))).filter(F.length("sentence") >= least)
    cited = said.select(id_col, "place", "sentence", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(FIGURE_REFERENCE), F.lit(1)))).alias("n")).withColumn("number", F.col("n").try_cast("int"))
    met = keys.join(cited, "number")
    once = met.groupBy("sheet", "number", F.substring("sentence", 1, 180).alias("head")).agg(F.min(F.struct(id_col, "place", "sentence")).alias("m")).select("sheet", "number", "m.*")
    w = Window.partitionBy("sheet").orderBy(id_col, "place")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= refs)


def resolve_images(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, path, status): references by their path, else by a file name that only one
    file has; ambiguous and unresolved ones are told apart."""
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    exact = refs.join(files.select(F.col("path").alias("ref"), F.col("path").alias("own")), "ref", "left").withColumn("name", name(F.col("ref")))
    names = files.groupBy(name(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("only"))
    met = exact.join(names, "name", "left")
    status = F.when(F.col("own").isNotNull(), "path").when(F.col("n") == 1, "name").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return met.select("ref", F.coalesce("own", F.when(F.col("n") == 1, F.col("only"))).alias("path"), status.alias("status"))


def split_posts(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, comment, body): forum pages split at their '**#N**' marks."""
    parts = F.regexp_extract_all(text_col, F.lit(r"(?s)\*\*#(\d+)\*\*(.*?)(?=\*\*#\d+\*\*|\z)"), F.lit(0))
    rows = docs.select(id_col, F.explode(parts).alias("part"))
    return rows.select(id_col, F.regexp_extract("part", r"\*\*#(\d+)\*\*", 1).cast("int").alias("comment"), clean_space(F.regexp_replace("part", r"^\*\*#\d+\*\*", "")).alias("body"))


def first_matches(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """(claim_id, finding_id, status): the first finding, in order of ``seq``, whose target
    contains the claim's; gaps are told apart. Claims are written by hand, so they are the
    small side of the containment join; more than ``MAX_CLAIMS`` are refused."""
    if claims.limit(MAX_CLAIMS + 1).count() > MAX_CLAIMS:
        raise ValueError(f"more than {MAX_CLAIMS} claims")
    met = findings.join(F.broadcast(claims.select("claim_id", F.lower("target").alias("t"))), F.expr("t <> '' AND contains(lower(target), t)"))
    first = met.groupBy("claim_id").agg(F.min_by("finding_id", "seq").alias("finding_id"))
    return claims.select("claim_id").join(first, "claim_id", "left").withColumn("status", F.when(F.col("finding_id").isNull(), "gap").otherwise("covered"))


def verification_level(cases: DataFrame) -> DataFrame:
    """V0 to V3 by what a case has: data, code, and a run that reproduced."""
    level = F.when(F.col("has_data") & F.col("has_code") & F.col("reproduced"), "V3").when(F.col("has_data") & F.col("has_code"), "V2").when(F.col("has_data") | F.col("has_code"), "V1").otherwise("V0")
    return cases.withColumn("level", level)


def review_counts(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(status, n): review items by the status of their latest decision; none is open."""
    last = decisions.groupBy("item_id").agg(F.max_by("status", "seq").alias("status"))
    return items.join(last, "item_id", "left").groupBy(F.coalesce("status", F.lit("open")).alias("status")).agg(F.count("*").alias("n"))


def version_history(reports: DataFrame) -> DataFrame:
    """(case_id, version, seq, prior): the latest report of each version, and how many
    versions came before it."""
    last = reports.groupBy("case_id", "version").agg(F.max("seq").alias("seq"))
    return last.withColumn("prior", F.row_number().over(Window.partitionBy("case_id").orderBy("version")) - 1)


def quality_flags(runs: DataFrame) -> DataFrame:
    """(case_id, flag, severity, n): steps that failed, fell back or were skipped."""
    severity = F.when(F.col("status") == "failed", "high").when(F.col("status") == "fallback", "medium").when(F.col("status") == "skipped", "low")
    flagged = runs.withColumn("severity", severity).filter("severity IS NOT NULL")
    return flagged.groupBy("case_id", F.col("status").alias("flag"), "severity").agg(F.count("*").alias("n"))
