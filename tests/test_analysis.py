"""All detectors over workbooks: known answers through real XLSX files."""

import pytest
from pyspark.sql import functions as F

from attesta.functions.scalars import index_to_col
from attesta.operators import analysis, findings
from tests.test_fixtures import book

PARAMETERS = {"min_pairs": 4, "support": 100, "max_offset": 8}


def letters(spark, count):
    return [r[0] for r in spark.range(1, count + 1).select(index_to_col(F.col("id").cast("int"))).collect()]


def sheet(names, cells):
    """Rows of a sheet from (row, col) -> number, text or (formula, number)."""
    out = []
    for row in sorted({r for r, _ in cells}):
        parts = []
        for (r, col), value in sorted(cells.items()):
            if r != row:
                continue
            ref = f"{names[col - 1]}{row}"
            if isinstance(value, str):
                parts.append(f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>')
            elif isinstance(value, tuple):
                parts.append(f'<c r="{ref}"><f>{value[0]}</f><v>{value[1]}</v></c>')
            else:
                parts.append(f'<c r="{ref}"><v>{value}</v></c>')
        out.append(f'<row r="{row}">{"".join(parts)}</row>')
    return "".join(out)


def columns(values, first_row=1):
    """(row, col) -> value from columns of values."""
    return {(first_row + i, c): v for c, own in values.items() for i, v in enumerate(own)}


PRICES = [(1, 2), (2, 6), (3, 12), (4, 20), (10, 20), (20, 60), (30, 120), (40, 200)]
TAILS = "5.438083 6.141738 6.692767 7.018653 6.952622 4.667768", "5.838083 6.041738 6.592767 6.018653 6.152622 7.467768"
SMALL = [(1.234567, 10.0, 10.5, 1.123456), (2.345678, 20.0, 20.5, 2.223456), (1.234567, 30.0, 30.5, 3.323456), (1.234567, 40.0, 40.5, 4.423456)]
PARTED = {(r, c): float(10**c * r) for r in range(1, 5) for c in (1, 2)}
LATE = {(r + 5, c): v + 0.01 for (r, c), v in PARTED.items()}
MARKS = {(5, 1): "Treatment B", (5, 2): "Treatment B"}


def workbooks():
    summary = columns({4: [100] * 10, 5: [*range(10, 20)], 7: [100 * r for r in range(10, 20)]}, 10)
    labels = {(1, 4): "N total", (1, 5): "Mean / Output voltage (V)", (1, 7): "Sum / Voltage (V)"}
    linear = lambda f: columns({1: [*range(1, 8)], 2: [f(x) for x in range(1, 8)]})
    semantic = columns({1: [a for a, _ in PRICES], 2: [b for _, b in PRICES]}, 2) | {(1, 1): "mean dose", (1, 2): "sd dose"}
    paste = columns({1: [1.25, 3.5, 4.75, 8.125, 9.375], 2: [4.25, 6.5, 7.75, 11.125, 12.375]}, 2)
    formula = {k: (f"A{k[0]}+3", v) if k[1] == 2 else v for k, v in paste.items()}
    return {
        "halves": {"s": columns({1: [a for a, _ in PRICES], 2: [b for _, b in PRICES]}) | {(r, c): 6 + c for r in (20, 30) for c in (1, 2)}},
        "long": {"s": columns({2: [i // 2 + 1 for i in range(16)], 3: [x for pair in PRICES for x in pair]})},
        "blocks": {"s": PARTED | MARKS | LATE},
        "one_mark": {"s": PARTED | {(5, 1): "Treatment B"} | LATE},
        "wide": {"s": PARTED | MARKS | {k: v * 7 + 900 for k, v in LATE.items()}},
        "tails": {f"Fig. {n}e": {(1, c + 1): float(x) for c, x in enumerate(row.split())} for n, row in zip((2, 7), TAILS, strict=True)},
        "small": {"s": {(r + 1, c + 1): v for r, row in enumerate(SMALL) for c, v in enumerate(row)}},
        "product": {"s": columns({1: [r + 1 for r in range(1, 6)], 2: [r + 2 for r in range(1, 6)], 3: [(r + 1) * (r + 2) for r in range(1, 6)]})},
        "windows": {"s": columns({1: [1.123456, 2.123457, 3.123458, 4.123459], 2: [5.912345, 6.912345, 7.912345, 8.912345]})},
        "twice": {"s": linear(lambda x: 2 * x)},
        "plus": {"s": linear(lambda x: x + 3)},
        "line": {"s": linear(lambda x: 2 * x + 0.3)},
        "summary": {"s": summary | labels},
        "semantic": {"s": semantic},
        "paste": {"s": paste},
        "paste_formula": {"s": formula},
        "zeros": {"s": {(r, c): 0 if r <= 35 else c * 100 + r for r in range(1, 41) for c in range(2, 18)}},
        "days": {"s": columns({1: [1.5, 2.5, 1.5, 2.5, 7.25, 8.25], 2: [3.5, 4.5, 3.5, 4.5, 9.125, 1.125]}, 2) | {(1, 1): "Day", (1, 2): "dose"}},
    }


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    names = letters(spark, 20)
    for name, sheets in workbooks().items():
        (folder / f"{name}.xlsx").write_bytes(book({n: sheet(names, cells) for n, cells in sheets.items()}))
    (folder / "broken.xlsx").write_bytes(b"no archive")
    rows, errors = analysis.analyze_folder(spark, str(folder), **PARAMETERS)
    assert [r.workbook for r in errors.collect()] == ["broken.xlsx"]
    rows = rows.cache()
    return rows, [r.asDict() for r in rows.collect()]


def of(found, workbook, category=None):
    return [r for r in found[1] if r["workbook"] == f"{workbook}.xlsx" and category in (None, r["category"])]


def test_repeated_half(found):
    assert {"paired_ratio_reuse", "row_offset_scalar_multiple", "duplicate_row_vector"} <= {r["category"] for r in of(found, "halves")}
    assert [(r["row_offset"], r["support"]) for r in of(found, "halves", "paired_ratio_reuse")] == [(4, 4)]
    own = findings.priority(found[0].filter("workbook = 'halves.xlsx'"))
    assert own.count() >= 3
    assert findings.clusters(own).count() >= 1


def test_long_format_without_a_named_id(found):
    assert [(r["columns"], r["row_offset"], r["support"]) for r in of(found, "long", "long_format_paired_ratio_reuse")] == [("2|3", 4, 4)]


def test_blocks(found):
    near = of(found, "blocks", "cross_block_paired_diff_too_narrow")
    assert sorted(r["columns"] for r in near) == ["1|0|1", "2|0|1"]
    assert all(r["finding_id"].startswith("CBD-") and r["risk_level"] == "medium" for r in near)
    assert not of(found, "one_mark", "cross_block_paired_diff_too_narrow")
    assert not of(found, "wide", "cross_block_paired_diff_too_narrow")


def test_tails_across_sheets(found):
    (row,) = of(found, "tails", "cross_sheet_fractional_tail_reuse")
    assert (row["support"], row["risk_level"]) == (6, "high")
    assert row["finding_id"].startswith("CFT-")


def test_small_tables(found):
    assert {"repeated_measurement_value", "fractional_tail_reuse", "small_n_fixed_difference"} <= {r["category"] for r in of(found, "small")}
    assert [(r["columns"], r["relationship"]) for r in of(found, "product", "binary_arithmetic_relation")] == [("1|2|3", "mul")]
    (row,) = of(found, "windows", "decimal_tail_match_shifted")
    assert (row["row_offset"], row["relationship"], row["support"]) == (1, "12345", 4)


def test_lines(found):
    assert not of(found, "twice", "strict_linear_relation")
    assert not of(found, "plus", "strict_linear_relation")
    (row,) = of(found, "line", "strict_linear_relation")
    assert (row["relationship"], row["support"], row["risk_level"], row["artifact_likelihood"]) == ("20000|300", 7, "medium", "unknown")


def test_what_labels_explain(found):
    reuse = of(found, "summary", "paired_ratio_reuse")
    assert reuse and {(r["risk_level"], r["artifact_likelihood"]) for r in reuse} == {("low", "high")}
    (ratio,) = of(found, "summary", "fixed_ratio")
    assert (ratio["risk_level"], ratio["artifact_likelihood"]) == ("low", "high")
    assert {(r["risk_level"], r["artifact_likelihood"]) for r in of(found, "semantic", "paired_ratio_reuse")} == {("low", "high")}
    assert {(r["risk_level"], r["artifact_likelihood"]) for r in of(found, "halves", "paired_ratio_reuse")} == {("medium", "unknown")}


def test_what_formulas_explain(found):
    assert {r["risk_level"] for r in of(found, "paste", "copy_paste_modify")} == {"medium"}
    assert {(r["risk_level"], r["artifact_likelihood"]) for r in of(found, "paste_formula", "copy_paste_modify")} == {("low", "unknown")}
    (row,) = of(found, "paste_formula", "formula_derived_column")
    assert (row["columns"], row["relationship"], row["risk_level"]) == ("2", "A<row>+3", "high")


def test_repeated_rows_of_zeros_and_days(found):
    (row,) = [r for r in of(found, "zeros", "duplicate_row_vector") if r["support"] == 35]
    assert (row["risk_level"], row["artifact_likelihood"], row["width"]) == ("medium", "high", 16)
    days = of(found, "days", "duplicate_row_vector")
    assert len(days) == 2 and {(r["risk_level"], r["artifact_likelihood"]) for r in days} == {("low", "high")}


def test_nothing_to_read(spark, tmp_path):
    rows, errors = analysis.analyze_folder(spark, str(tmp_path))
    assert rows.count() == errors.count() == 0


def test_parameters():
    assert analysis.checked({})["max_offset"] == 80
    for wrong in ({"min_pairs": 1}, {"support": 101}, {"max_offset": 0}, {"support": 95.5}, {"offset": 3}, {"min_pairs": True}):
        with pytest.raises(ValueError, match="parameter|must be"):
            analysis.checked(wrong)
    assert {c for d in analysis.DETECTORS for c in d.categories} | {"formula_derived_column"} == {*findings.PREFIX}
