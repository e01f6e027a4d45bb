"""Tables and lists in HTML and markdown text, as rows of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.similarity import checkpointed

#: The entities that text of tables uses.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def plain(html: Column) -> Column:
    """Text without tags, entities replaced, white space folded."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, text in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(text))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def elements(docs: DataFrame, tag: str, id_col: str, html_col: str) -> DataFrame:
    """(id, place, body): the text of every ``tag`` element, in order; nested ones end at
    the first closing tag."""
    found = F.regexp_extract_all(html_col, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))
    return docs.select(id_col, F.posexplode(found).alias("place", "raw")).select(id_col, "place", plain(F.col("raw")).alias("body"))


def html_cells(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, row, col, body): cells of HTML tables, rows counted through the text."""
    rows = F.regexp_extract_all(html_col, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr\s*>"), F.lit(1))
    cells = F.regexp_extract_all("raw", F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]\s*>"), F.lit(1))
    found = docs.select(id_col, F.posexplode(rows).alias("row", "raw")).select(id_col, "row", F.posexplode(cells).alias("col", "cell"))
    return found.select(id_col, "row", "col", plain(F.col("cell")).alias("body"))


def pipe_cells(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, line, col, body): cells of markdown pipe tables; rule lines are left out."""
    rows = lines.filter(F.trim("body").startswith("|") & ~F.trim("body").rlike(r"^\|[\s:|-]+\|?$"))
    parts = F.split(F.regexp_replace(F.trim("body"), r"^\||\|$", ""), r"\|")
    return rows.select(id_col, "line", F.posexplode(parts).alias("col", "cell")).select(id_col, "line", "col", F.trim("cell").alias("body"))


def blocks(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, type, text): typed blocks of JSON trees whose children are in 'blocks', of
    any depth. A level at a time is parsed, with its children kept as JSON text, until no
    tree has a further level."""
    level = docs.select(id_col, F.lit("0").alias("path"), F.col(json_col).alias("_json"))
    out = None
    while True:
        parsed = level.select(id_col, "path", F.from_json("_json", "type string, text string, blocks array<string>").alias("b"))
        rows = parsed.select(id_col, "path", "b.type", "b.text").filter("type IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
        children = parsed.select(id_col, "path", F.posexplode("b.blocks").alias("k", "_json"))
        level = checkpointed(children.select(id_col, F.concat_ws(".", "path", F.col("k").cast("string")).alias("path"), "_json"))
        if level.isEmpty():
            return out
