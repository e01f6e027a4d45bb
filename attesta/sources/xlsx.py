"""Spreadsheets as cells: OOXML workbooks read by executors with the standard library.

``binaryFile`` lists and reads the files, one row each; a task unpacks its workbooks and
streams over the sheet parts, so rows leave as they are parsed. A workbook that can't be
read becomes one row with an error and stops nothing else."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "workbook string, sheet string, row int, col int, ref string, cell_type string, raw string, value string, formula string, error string"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Cells of one output batch.
BATCH = 5000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_REF = re.compile(r"([A-Z]+)(\d+)$")


def column_number(letters: str) -> int:
    out = 0
    for c in letters:
        out = out * 26 + ord(c) - 64
    return out


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, part) of each sheet in workbook order."""
    links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links.get(s.get(_LINK), "")
        yield s.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def parse(name: str, content: bytes) -> Iterator[tuple]:
    """Cells of a workbook in the order of ``SCHEMA``; empty cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = set(book.namelist())
        shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in parts else []
        for sheet, part in _sheets(book):
            with book.open(part) as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{_MAIN}row":
                        node.clear()
                    if node.tag != f"{_MAIN}c" or not (m := _REF.match(node.get("r", ""))):
                        continue
                    kind = node.get("t", "n")
                    raw, formula = node.findtext(f"{_MAIN}v"), node.findtext(f"{_MAIN}f")
                    value = _text(node) if kind == "inlineStr" else raw
                    if kind == "s" and raw is not None:
                        value = shared[int(raw)] if int(raw) < len(shared) else None
                    if value is not None or formula is not None:
                        yield name, sheet, int(m[2]), column_number(m[1]), m[0], kind, raw, value, formula, None


def read(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all .xlsx files below a folder, editors' lock files aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    files = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content").filter(~F.col("name").startswith("~$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 6]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)

        for batch in batches:
            rows: list[tuple] = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for cell in parse(name, content.as_py()):
                        rows.append(cell)
                        if len(rows) == BATCH:
                            yield pack(rows)
                            rows = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
                    rows.append((name, *[None] * 8, f"{type(e).__name__}: {e}"[:300]))
            if rows:
                yield pack(rows)

    return files.mapInArrow(run, SCHEMA)


def numeric(cells: DataFrame) -> DataFrame:
    """The numeric cells as (workbook, sheet, row, col, v) in millionths; strings, inline
    strings, formula strings and booleans are no numbers."""
    from attesta.sources.cells import micro

    x = F.col("value").try_cast("double")
    plain = ~F.col("cell_type").isin("s", "str", "inlineStr", "b") & F.col("error").isNull()
    return cells.filter(plain & x.isNotNull() & ~F.isnan(x)).select("workbook", "sheet", "row", "col", micro(x).alias("v")).filter("v IS NOT NULL")


def labels(cells: DataFrame, top_rows: int = 30, most: int = 4) -> DataFrame:
    """(workbook, sheet, col, label): up to ``most`` distinct texts of a column's first
    rows, in row order, joined by ' / '."""
    texts = cells.filter((F.col("row") <= top_rows) & F.col("cell_type").isin("s", "str", "inlineStr") & (F.trim("value") != ""))
    first = texts.groupBy("workbook", "sheet", "col", "value").agg(F.min("row").alias("row"))
    ordered = F.array_sort(F.collect_list(F.struct("row", "value")))
    return first.groupBy("workbook", "sheet", "col").agg(F.array_join(F.transform(F.slice(ordered, 1, most), lambda x: x["value"]), " / ").alias("label"))


def row_labels(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, row, label): the distinct texts of a row, in column order, joined
    by ' / '."""
    texts = cells.filter(F.col("cell_type").isin("s", "str", "inlineStr") & (F.trim("value") != ""))
    first = texts.groupBy("workbook", "sheet", "row", "value").agg(F.min("col").alias("col"))
    ordered = F.array_sort(F.collect_list(F.struct("col", "value")))
    return first.groupBy("workbook", "sheet", "row").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), " / ").alias("label"))


def separators(cells: DataFrame, least: int = 2) -> DataFrame:
    """(workbook, sheet, row) of rows with text in ``least`` cells or more and no number,
    strictly between numeric rows."""
    number = ~F.col("cell_type").isin("s", "str", "inlineStr", "b") & F.col("value").try_cast("double").isNotNull()
    rows = cells.filter("error IS NULL").groupBy("workbook", "sheet", "row").agg(F.count_if(number).alias("numbers"), F.count_if(F.col("cell_type").isin("s", "str", "inlineStr")).alias("texts"))
    span = rows.filter("numbers > 0").groupBy("workbook", "sheet").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    return rows.join(span, ["workbook", "sheet"]).filter((F.col("numbers") == 0) & (F.col("texts") >= least) & (F.col("row") > F.col("low")) & (F.col("row") < F.col("high"))).select("workbook", "sheet", "row")


def formulas(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, col, n, pattern, share, risk_level): columns of three formulas or
    more with their modal pattern; the pattern seen first wins a tie."""
    from attesta.functions.scalars import formula_pattern

    f = cells.filter("formula IS NOT NULL").withColumn("pattern", formula_pattern(F.col("formula")))
    counts = f.groupBy("workbook", "sheet", "col", "pattern").agg(F.count("*").alias("k"), F.min("row").alias("first"))
    best = counts.groupBy("workbook", "sheet", "col").agg(F.sum("k").alias("n"), F.max(F.struct("k", (-F.col("first")).alias("early"), "pattern")).alias("m")).filter("n >= 3")
    share = F.col("m.k") / F.col("n")
    return best.select("workbook", "sheet", "col", "n", F.col("m.pattern").alias("pattern"), share.alias("share"), F.when((F.col("n") >= 5) & (share >= 0.5), "high").otherwise("medium").alias("risk_level"))
