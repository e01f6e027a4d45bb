"""Numbers, rules and claims in text: extraction, matching and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A number in running text. The character before it is captured instead of looked behind
#: at, so that one pattern serves every dialect.
NUMBER = r"(^|[^A-Za-z0-9_.-])([-+]?\d+(?:,\d{3})*(?:\.\d+)?%?)"
#: Rules that are broadcast with their patterns; a rule base is written by hand.
MAX_RULES = 10_000


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, body): the lines of each text, counted from one."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("k", "body")).select(id_col, (F.col("k") + 1).alias("line"), "body")


def numbers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, place, raw, x): every number of every line, with commas and per cent
    signs stripped for its value; texts that aren't numbers after all have a null value."""
    found = lines(docs, id_col, text_col).select(id_col, "line", F.posexplode(F.regexp_extract_all("body", F.lit(NUMBER), F.lit(2))).alias("place", "raw"))
    return found.withColumn("x", F.translate("raw", "%,", "").try_cast("double"))


def line_kind(body: Column) -> Column:
    """Kind of a markdown line."""
    t = F.trim(body)
    return (
        F.when(t == "", "blank")
        .when(t.rlike(r"^!\[[^\]]*\]\([^)]*\)"), "image")
        .when(t.startswith("|") | F.lower(t).startswith("<table"), "table")
        .when(F.lower(t).rlike(r"^(fig(ure|\.)?|table|extended data fig)\s*\.?\s*[0-9]+"), "caption")
        .when(t.startswith("#"), "heading")
        .otherwise("text")
    )


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block, kind, first_line, last_line, n_lines): stretches of lines of one kind;
    blank lines part them and are left out."""
    kinds = lines(docs, id_col, text_col).withColumn("kind", line_kind(F.col("body")))
    w = Window.partitionBy(id_col).orderBy("line")
    changed = F.coalesce(F.lag("kind").over(w) != F.col("kind"), F.lit(True)).cast("int")
    placed = kinds.withColumn("changed", changed).withColumn("block", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.filter("kind <> 'blank'").groupBy(id_col, "block", "kind").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n_lines"))


def match_rules(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 60) -> DataFrame:
    """(id, rule_id, severity, excerpt): rules (rule_id, severity, enabled, pattern,
    negative) that hold in a text: enabled, the pattern found, the negative pattern not.
    The excerpt reaches ``reach`` characters around the first hit, line feeds as blanks.
    Patterns are lower case; texts are folded. A rule base is broadcast if it is small;
    a larger one is refused, as it was not written by hand."""
    active = rules.filter("enabled AND pattern IS NOT NULL").select("rule_id", "severity", "pattern", "negative")
    if active.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    low = F.lower(F.col("_text"))
    texts = docs.filter(F.length(F.trim(text_col)) > 0).select(id_col, F.col(text_col).alias("_text"))
    met = texts.join(F.broadcast(active), F.expr("lower(_text) RLIKE pattern AND (negative IS NULL OR NOT lower(_text) RLIKE negative)"))
    hit = F.regexp_instr(low, F.col("pattern"))
    start = F.greatest(F.lit(1), hit - reach)
    excerpt = F.regexp_replace(F.col("_text").substr(start, hit - start + reach), "\n", " ")
    return met.select(id_col, "rule_id", "severity", excerpt.alias("excerpt"))


def match_summary(matches: DataFrame) -> DataFrame:
    """(severity, n_matches, n_documents, risk_level) of rule matches."""
    risk = F.when(F.col("severity") == "red", "high").when(F.col("severity") == "orange", "medium").otherwise("low")
    return matches.groupBy("severity").agg(F.count("*").alias("n_matches"), F.count_distinct("doc_id").alias("n_documents")).withColumn("risk_level", risk)


def reconcile_claims(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claims (id, dataset, metric, expected, tolerance) against result rows (dataset,
    metric, value, seq): the last row of a key counts. Status is missing, unparsed,
    mismatched (off by more than the tolerance) or matched."""
    last = results.groupBy("dataset", "metric").agg(F.max_by("value", "seq").alias("value"))
    met = claims.join(last, ["dataset", "metric"], "left").withColumn("actual", F.col("value").try_cast("double"))
    status = F.when(F.col("value").isNull(), "missing").when(F.col("actual").isNull(), "unparsed").when(F.abs(F.col("actual") - F.col("expected")) > F.col("tolerance"), "mismatched").otherwise("matched")
    return met.select("id", "dataset", "metric", "expected", "actual", status.alias("status"))


def missing_panels(expected: DataFrame, covered: DataFrame) -> DataFrame:
    """(figure, n_missing, panels): panels (figure, panel) of the paper without source
    data, one row per figure."""
    gone = expected.join(covered, ["figure", "panel"], "left_anti").distinct()
    return gone.groupBy("figure").agg(F.count("*").alias("n_missing"), F.array_join(F.array_sort(F.collect_list("panel")), ",").alias("panels"))


def link_captions(captions: DataFrame, items: DataFrame) -> DataFrame:
    """(caption_id, item_id, confidence): captions (caption_id, label, page) against items
    (item_id, label, page). A label that names one item links it (high); of the captions
    left, the first of a page takes the only item without a caption there (medium)."""
    one = items.filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id")).filter("n = 1")
    high = captions.join(one, "label").select("caption_id", "item_id", F.lit("high").alias("confidence"))
    left = captions.join(high, "caption_id", "left_anti")
    free = items.join(high, "item_id", "left_anti").groupBy("page").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id")).filter("n = 1")
    first = left.groupBy("page").agg(F.min("caption_id").alias("caption_id"))
    return high.unionByName(first.join(free, "page").select("caption_id", "item_id", F.lit("medium").alias("confidence")))
