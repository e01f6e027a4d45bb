"""The shared analysis on one workbook of planted sheets, with the SQL of its detectors.

Every detector's SQL is the one of its own query, over the cells planted here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import analysis
from attesta.operators import findings as ops
from attesta.plans import blocks, findings, relations, sheets
from attesta.sources.cells import unpivot

#: Columns of the sheets from the first two: a copy, a difference, a ratio, a line, a quotient.
_COLUMNS = ["v1", "v2", "v1", "v1 + 3500000", "v1 * 2", "v1 * 2 + 300000", "CAST({0}(CAST(v1 AS DOUBLE) * 1e6 / CAST(v2 AS DOUBLE)) AS BIGINT)"]


def event_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values by user that repeat every 13 to 32 rows (``sheets.offset_cells``), with
    five columns that follow from the first two."""
    two = sheets.offset_cells(spark, sf_dir).groupBy("workbook", "sheet", "row").agg(*[F.max(F.when(F.col("col") == k, F.col("v"))).alias(f"v{k}") for k in (1, 2)])
    return unpivot(two, [F.expr(c.format("rint")) for c in _COLUMNS])


_CELLS = f"""{sheets.OFFSET_SQL.replace("cells AS", "two AS")}, planted AS (SELECT workbook, sheet, row, max(v) FILTER (col = 1) AS v1, max(v) FILTER (col = 2) AS v2 FROM two GROUP BY ALL),
    cells AS ({sheets._union([c.format("round_even") if "{0}" not in c else c.format("round_even").replace("AS DOUBLE)) AS BIGINT)", "AS DOUBLE), 0) AS BIGINT)") for c in _COLUMNS], "planted")})"""


def analysis_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all detectors over the workbook, numbered by category."""
    cells = event_workbook(spark, sf_dir)
    return analysis.analyze(cells, **sheets.planted_known(cells))


def _moved(sql: str, own: str, raw: bool = False) -> str:
    """A detector's SQL over the workbook's cells instead of its ``own`` ones."""
    name = lambda text: text.replace("cells AS", "raw AS") if raw else text
    if name(own) not in sql:
        raise ValueError("these cells aren't in the query")
    return sql.replace(name(own), "raw AS".join(_CELLS.rsplit("cells AS", 1)) if raw else _CELLS)


def _part(name: str, sql: str) -> str:
    """A detector's rows in the common fields, from the registry of the analysis."""
    detector = next(d for d in analysis.DETECTORS if d.name == name)
    has = _HAS[name]
    pick = lambda f: detector.fields.get(f, f if f in has else "'unknown'" if f == "artifact_likelihood" else "NULL")
    named = {"workbook": "'events'"}
    quoted = lambda text: text.replace("CAST(left ", 'CAST("left" ').replace("CAST(right ", 'CAST("right" ').replace(" AS STRING", " AS VARCHAR")
    return f"SELECT {', '.join(f'CAST({named.get(f) or quoted(pick(f))} AS {kind}) AS {f}' for f, kind in analysis.FIELDS.items())} FROM ({sql})"


_COMMON = {"workbook", "sheet", "category", "risk_level", "support", "overlap", "support_rate"}
_GATED = _COMMON | {"artifact_likelihood"}
#: Common fields that a detector's rows have by name.
_HAS = {
    "relations": _GATED, "row_offset_reuse": _COMMON | {"columns", "row_offset"}, "paired_ratio_reuse": {"workbook", "sheet", "category", "risk_level", "support", "overlap", "row_offset", "artifact_likelihood"},
    "duplicate_rows": {"sheet", "category", "risk_level", "width", "artifact_likelihood"}, "rounding_bias": {"sheet", "category", "row_offset"}, "pair_spread": {"sheet", "category", "risk_level", "overlap", "artifact_likelihood"},
    "repeated_values": {"sheet", "category", "risk_level"}, "tail_reuse": {"sheet", "category", "risk_level"}, "small_n_fixed": {"sheet", "category", "risk_level"}, "cross_sheet_tails": {"category", "risk_level", "support"},
    "binary_arithmetic": _GATED, "copy_paste_modify": _GATED, "shifted_paste": _GATED, "internal_sequence": {"sheet", "category", "risk_level", "artifact_likelihood"}, "decimal_tail_shifted": _GATED, "strict_linear": {"sheet", "category", "risk_level", "artifact_likelihood"},
}
_RELATIONS, _BLOCKS = relations.SQL, blocks.SQL
_OWN_TAILS = _BLOCKS["cross_sheet_tails"][len("WITH ") : _BLOCKS["cross_sheet_tails"].index(f", {blocks._TAILED}")]
_PARTS = [
    *[("relations", _moved(_RELATIONS[k].replace(sheets.KNOWN_SQL, sheets.PLANTED_SQL), sheets.SUPPLIER_SQL)) for k in ("duplicate_columns", "fixed_difference", "fixed_ratio")],
    ("row_offset_reuse", _moved(_RELATIONS["row_offset_reuse"], sheets.OFFSET_SQL, raw=True)),
    ("paired_ratio_reuse", _moved(_RELATIONS["paired_ratio_reuse"], sheets.OFFSET_SQL, raw=True)),
    ("duplicate_rows", _moved(_BLOCKS["duplicate_rows"], blocks._GROUP)),
    ("rounding_bias", _moved(_RELATIONS["rounding_bias"], relations._BIAS_CELLS, raw=True)),
    ("pair_spread", _moved(_RELATIONS["pair_spread"], sheets.SUPPLIER_SQL, raw=True)),
    ("repeated_values", _moved(_BLOCKS["repeated_values"], relations._BIAS_CELLS)),
    ("tail_reuse", _moved(_BLOCKS["tail_reuse"], relations._TAIL_CELLS)),
    ("small_n_fixed", _moved(_RELATIONS["small_n_fixed"], sheets.SUPPLIER_SQL)),
    ("cross_sheet_tails", _moved(_BLOCKS["cross_sheet_tails"], _OWN_TAILS)),
    ("binary_arithmetic", _moved(_RELATIONS["binary_arithmetic"], sheets.UNIT_SQL)),
    ("copy_paste_modify", _moved(_RELATIONS["copy_paste_modify"], sheets.ORDER_SQL)),
    ("shifted_paste", _moved(_RELATIONS["shifted_paste"], sheets.ORDER_SQL)),
    ("internal_sequence", _moved(_BLOCKS["internal_sequence"], blocks._RAMP)),
    ("decimal_tail_shifted", _moved(_RELATIONS["decimal_tail_shifted"], relations._TAIL_CELLS)),
    ("strict_linear", _moved(_RELATIONS["strict_linear"], sheets.SUPPLIER_SQL)),
]
_ALL = findings._numbered_sql([_part(*p) for p in _PARTS])

QUERIES = {
    "workbook_analysis": analysis_findings,
    "workbook_clusters": lambda s, d: ops.clusters(ops.priority(analysis_findings(s, d))),
}
SQL = {
    "workbook_analysis": f"WITH {_ALL} SELECT {findings._FIELDS} FROM f",
    "workbook_clusters": f"WITH {_ALL}, {findings._CLUSTERS} SELECT * FROM c",
}
