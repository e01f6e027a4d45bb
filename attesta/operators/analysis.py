"""All spreadsheet detectors over one set of cells.

Cells, their gathered rows, the informative cells and theirs are each made once, as tables
in the shared folder, and every detector reads one of these four. What is known besides
the numbers - labels of columns and rows, formulas, separator rows - comes as relations of
its own, which ``sources.xlsx`` reads from workbooks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import arithmetic, blocks, findings, fractions, offsets, pairs
from attesta.operators.columns import informative
from attesta.operators.similarity import checkpointed
from attesta.sources import xlsx
from attesta.sources.cells import SCHEMA

#: Parameters of the analysis: least value, greatest value, default.
PARAMETERS = {"min_pairs": (2, 10_000, 8), "support": (50, 100, 95), "max_offset": (1, 1_000, 80), "min_width": (1, 1_000, 2), "relation_support": (50, 100, 98)}


def checked(given: dict[str, int]) -> dict[str, int]:
    """The parameters with their defaults. Raises ValueError for a name that isn't one, a
    value that isn't whole, or one out of its range."""
    for name, value in given.items():
        if name not in PARAMETERS:
            raise ValueError(f"unknown parameter {name!r}")
        least, greatest, _ = PARAMETERS[name]
        if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= greatest:
            raise ValueError(f"{name} must be a whole number from {least} to {greatest}, not {value!r}")
    return {name: given.get(name, default) for name, (_, _, default) in PARAMETERS.items()}


@dataclass(frozen=True)
class Workbooks:
    """What the detectors read: cells and gathered rows, whole and of informative columns."""

    cells: DataFrame
    rows: DataFrame
    fine: DataFrame
    fine_rows: DataFrame
    separators: DataFrame
    long: DataFrame
    labels: DataFrame | None = None
    formulas: DataFrame | None = None
    row_labels: DataFrame | None = None
    parameters: dict[str, int] = field(default_factory=dict)

    @property
    def known(self) -> dict[str, DataFrame | None]:
        return {"labels": self.labels, "formulas": self.formulas}


@dataclass(frozen=True)
class Detector:
    """A detector, the categories of its findings, and their common fields as expressions
    over its rows; fields without one are taken by name or null."""

    name: str
    run: Callable[[Workbooks], DataFrame]
    categories: tuple[str, ...]
    fields: dict[str, str]


_PAIR = "concat_ws('|', CAST(left AS STRING), CAST(right AS STRING))"
_VALUE = "CAST(value AS STRING)"
DETECTORS = (
    Detector("relations", lambda w: pairs.relations(w.cells, support=w.parameters["relation_support"], rows=w.rows, **w.known), tuple(pairs.RELATIONS), {"columns": _PAIR, "relationship": _VALUE}),
    Detector("row_offset_reuse", lambda w: offsets.row_offset_reuse(w.fine, **_offset(w), formulas=w.formulas, narrowed=True), ("row_offset_exact_reuse", "row_offset_scalar_multiple"), {"relationship": "CAST(ratio AS STRING)"}),
    Detector("paired_ratio_reuse", lambda w: offsets.paired_ratio_reuse(w.cells, **_offset(w), labels=w.labels, rows=w.fine_rows), ("paired_ratio_reuse",), {"columns": _PAIR}),
    Detector("duplicate_rows", lambda w: blocks.duplicate_rows(w.cells, w.parameters["min_width"], w.labels), ("duplicate_row_vector",), {"columns": "CAST(first_row AS STRING)", "support": "n", "overlap": "n"}),
    Detector("long_format_reuse", lambda w: offsets.long_format_ratio_reuse(w.long, **_offset(w), keys=offsets.LONG), ("long_format_paired_ratio_reuse",), {"columns": "concat_ws('|', CAST(id_col AS STRING), CAST(value_col AS STRING))", "risk_level": "CASE WHEN support >= 10 THEN 'high' ELSE 'medium' END"}),
    Detector("long_format_enrichment", lambda w: offsets.long_format_enrichment(w.long, w.parameters["min_pairs"], keys=offsets.LONG), ("long_format_within_pair_ratio_enrichment",), {"columns": "concat_ws('|', CAST(id_col AS STRING), CAST(value_col AS STRING))", "relationship": "CAST(ratio AS STRING)"}),
    Detector("rounding_bias", lambda w: offsets.rounding_bias(w.fine, w.parameters["max_offset"], w.parameters["min_pairs"], narrowed=True), ("row_offset_partial_copy_rounding_bias",), {"columns": "CAST(col AS STRING)", "risk_level": "'high'", "support": "exact", "overlap": "n"}),
    Detector("pair_spread", lambda w: pairs.pair_spread(w.cells, w.parameters["min_pairs"], rows=w.fine_rows), ("paired_difference_too_narrow",), {"columns": _PAIR}),
    Detector("cross_blocks", lambda w: blocks.cross_blocks(w.cells, w.separators, min_pairs=w.parameters["min_pairs"]), ("cross_block_paired_diff_too_narrow",), {"columns": "concat_ws('|', CAST(col AS STRING), CAST(block_x AS STRING), CAST(block_y AS STRING))", "support": "n_rows", "overlap": "n_rows"}),
    Detector("repeated_values", lambda w: fractions.repeated_values(w.cells), ("repeated_measurement_value",), {"columns": "'-'", "relationship": _VALUE, "support": "n"}),
    Detector("tail_reuse", lambda w: fractions.tail_reuse(w.cells), ("fractional_tail_reuse",), {"columns": "'-'", "relationship": "CAST(tail AS STRING)", "support": "n"}),
    Detector("small_n_fixed", lambda w: pairs.small_n_fixed(w.cells, rows=w.rows), ("small_n_fixed_difference", "small_n_fixed_ratio"), {"columns": _PAIR, "relationship": _VALUE, "support": "n", "overlap": "n"}),
    Detector("cross_sheet_tails", lambda w: fractions.cross_sheet_tails(w.cells, row_labels=w.row_labels), ("cross_sheet_fractional_tail_reuse",), {"sheet": "sheet_x", "columns": "concat_ws('|', CAST(row_x AS STRING), sheet_y, CAST(row_y AS STRING))"}),
    Detector("binary_arithmetic", lambda w: arithmetic.binary_arithmetic(w.cells, rows=w.rows, **w.known), ("binary_arithmetic_relation",), {"columns": "concat_ws('|', CAST(c1 AS STRING), CAST(c2 AS STRING), CAST(c3 AS STRING))", "relationship": "op"}),
    Detector("copy_paste_modify", lambda w: fractions.copy_paste_modify(w.cells, **w.known), ("copy_paste_modify",), {"columns": _PAIR, "relationship": "CAST(delta AS STRING)"}),
    Detector("shifted_paste", lambda w: fractions.shifted_paste(w.cells, **w.known), ("shifted_paste",), {"columns": _PAIR, "row_offset": "lag", "relationship": "CAST(delta AS STRING)"}),
    Detector("internal_sequence", lambda w: blocks.sequences(w.cells, formulas=w.formulas), ("internal_sequence_relation",), {"columns": "CAST(col AS STRING)", "relationship": "concat_ws('|', relation, CAST(start AS STRING))", "support": "n"}),
    Detector("decimal_tail_shifted", lambda w: fractions.decimal_tail_shifted(w.cells, **w.known), ("decimal_tail_match_shifted",), {"columns": _PAIR, "row_offset": "shift", "relationship": "CAST(token AS STRING)"}),
    Detector("strict_linear", lambda w: pairs.strict_linear(w.cells, rows=w.rows, **w.known), ("strict_linear_relation",), {"columns": _PAIR, "relationship": "concat_ws('|', CAST(slope AS STRING), CAST(intercept AS STRING))", "support": "n", "overlap": "n"}),
)
#: Fields of a finding and their types.
FIELDS = {"workbook": "STRING", "sheet": "STRING", "category": "STRING", "risk_level": "STRING", "columns": "STRING", "row_offset": "INT", "relationship": "STRING", "width": "INT", "support": "BIGINT", "overlap": "BIGINT", "support_rate": "DOUBLE", "artifact_likelihood": "STRING"}


def _offset(w: Workbooks) -> dict[str, int]:
    return {"max_offset": w.parameters["max_offset"], "least": w.parameters["min_pairs"], "support": w.parameters["support"]}


def common(detector: Detector, found: DataFrame) -> DataFrame:
    """A detector's rows in the common fields; what it doesn't say of artifacts is unknown."""
    pick = lambda name: detector.fields.get(name, name if name in found.columns else "'unknown'" if name == "artifact_likelihood" else "NULL")
    return found.selectExpr(*[f"CAST({pick(name)} AS {kind}) AS {name}" for name, kind in FIELDS.items()])


def prepared(cells: DataFrame, labels: DataFrame | None = None, formulas: DataFrame | None = None, separators: DataFrame | None = None, row_labels: DataFrame | None = None, **parameters: int) -> Workbooks:
    """The shared tables of ``cells`` (workbook, sheet, row, col, v)."""
    known = checked(parameters)
    cells = checkpointed(cells.select("workbook", "sheet", "row", "col", "v"))
    fine = checkpointed(informative(cells, known["min_pairs"], 1))
    marks = cells.sparkSession.createDataFrame([], "workbook string, sheet string, row int") if separators is None else separators
    rows, fine_rows = checkpointed(pairs.gathered(cells)), checkpointed(pairs.gathered(fine))
    long = checkpointed(offsets.long_pairs(offsets.long_rows(cells, fine, known["min_pairs"]), least=known["min_pairs"], keys=offsets.LONG))
    return Workbooks(cells, rows, fine, fine_rows, marks, long, labels, formulas, row_labels, known)


def analyze(cells: DataFrame, labels: DataFrame | None = None, formulas: DataFrame | None = None, separators: DataFrame | None = None, row_labels: DataFrame | None = None, formula_findings: DataFrame | None = None, **parameters: int) -> DataFrame:
    """The findings of all detectors over ``cells`` (workbook, sheet, row, col, v), with
    their ids: relations of column pairs, offsets, long format, blocks, repeated rows and
    values, decimal parts, arithmetic and, given ``formula_findings`` (of
    ``xlsx.formulas``), formula columns. ``labels`` (workbook, sheet, col, label) and
    ``formulas`` (workbook, sheet, col) lower what they explain; ``separators`` (workbook,
    sheet, row) part blocks; ``row_labels`` (workbook, sheet, row, label) name rows.
    Parameters are those of ``PARAMETERS``. No cells give no findings."""
    workbooks = prepared(cells, labels, formulas, separators, row_labels, **parameters)
    parts = [common(d, d.run(workbooks)) for d in DETECTORS]
    if formula_findings is not None:
        named = formula_findings.withColumns({"category": F.lit("formula_derived_column"), "columns": F.col("col").cast("string"), "relationship": F.col("pattern"), "support": F.col("n"), "overlap": F.col("n"), "support_rate": F.col("share")})
        parts.append(common(Detector("formulas", lambda w: named, ("formula_derived_column",), {}), named))
    return findings.numbered(parts)


def analyze_folder(spark: SparkSession, path: str, **parameters: int) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of the workbooks below a folder; errors are (workbook, error) of
    those that can't be read."""
    raw = checkpointed(xlsx.read(spark, path))
    formulas = xlsx.formulas(raw)
    with_formula = raw.filter("formula IS NOT NULL").select("workbook", "sheet", "col").distinct()
    found = analyze(xlsx.numeric(raw), xlsx.labels(raw), with_formula, xlsx.separators(raw), xlsx.row_labels(raw), formulas, **parameters)
    return found, raw.filter("error IS NOT NULL").select("workbook", "error")


__all__ = ["DETECTORS", "PARAMETERS", "SCHEMA", "analyze", "analyze_folder", "checked", "prepared"]
