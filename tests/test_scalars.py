import pytest
from pyspark.sql import functions as F

from attesta.functions import scalars as s
from attesta.operators import gates
from attesta.sources import markup


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "index"), [("A", 1), ("Z", 26), ("AA", 27), ("AZ", 52), ("ZZ", 702), ("AAA", 703), ("XFD", 16384)])
def test_column_letters(spark, name, index):
    assert value(spark, s.col_to_index(F.lit(name))) == index
    assert value(spark, s.index_to_col(F.lit(index))) == name


def test_numbers(spark):
    got = [value(spark, s.parse_number(F.lit(x))) for x in ("1,234.5", "12%", "1e3", "NaN", "Infinity", "", "x", "-.5")]
    assert got == [1234.5, 12.0, 1000.0, None, None, None, None, -0.5]
    assert [value(spark, s.decimal_places(F.lit(x))) for x in ("1.50", "3", "0.125")] == [2, 0, 3]
    assert [value(spark, s.integer_delta(F.lit(a), F.lit(b))) for a, b in ((1_250_000, 4_250_000), (-1_200_000, 2_200_000), (1_000_000, 2_000_000))] == [3, None, None]
    assert value(spark, s.row_range(F.lit("2-15"))) == (2, 15) and value(spark, s.row_range(F.lit("B-E"))) is None


def test_labels_and_figures(spark):
    assert value(spark, s.label_key(F.lit("Fig. 3 (b)"))) == "fig3b"
    assert value(spark, s.figure_key(F.lit("ED Fig. 3d"))) == ("extended", 3, "d")
    assert value(spark, s.figure_key(F.lit("Figure 12"))) == ("main", 12, "")
    assert value(spark, s.figure_key(F.lit("Notes"))) is None
    assert [value(spark, s.panel_range(F.lit(x))) for x in ("l-n", "b", "a-z", "c-a")] == [["l", "m", "n"], ["b"], [], []]
    assert value(spark, s.sentences(F.lit("One. Two!  Three"))) == ["One.", "Two!", "Three"]
    assert value(spark, s.formula_pattern(F.lit("=SUM($A$12,B7)"))) == "=SUM(A<row>,B<row>)"


def test_shapes(spark):
    square = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 3D), named_struct('x', 0D, 'y', 3D))")
    assert value(spark, s.polygon_area(square)) == 6.0
    assert value(spark, s.box_overlap(F.array(*map(F.lit, (0, 0, 4, 4))), F.array(*map(F.lit, (2, 3, 9, 9))))) == 2
    parts = value(spark, s.affine_parts(F.lit(0.0), F.lit(-2.0), F.lit(2.0), F.lit(0.0)))
    assert (round(parts.angle), parts.scale, parts.flipped) == (90, 2.0, False)
    assert value(spark, s.min_rotation_distance(F.array(F.lit(7), F.lit(8)), F.array(F.lit(15), F.lit(0)))) == 1
    assert value(spark, s.image_risk(F.lit(0.75), F.lit(None).cast("string"))) == "high"
    assert value(spark, s.image_risk(F.lit(0.9), F.lit("Graphs"))) == "info"


def test_gates(spark):
    rows = [("w", "s", r, 1, 2, 5_000_000 + r % 2, 5_000_000) for r in range(1, 9)] + [("w", "t", r, 1, 2, r * 1_000_000, (9 - r) * 3_000_000) for r in range(1, 9)]
    pairs = spark.createDataFrame(rows, "workbook string, sheet string, row int, left int, right int, a long, b long")
    assert {r.sheet: r.instrument for r in gates.instrument(pairs).collect()} == {"s": True, "t": False}
    rel = spark.sql("SELECT * FROM VALUES ('a', 'b', 0.5D, array(1, 2), 'm'), ('a', 'a', 2.0D, array(-1), 'm'), (null, 'b', null, array(), 'm') AS t(source, target, score, bbox, method)")
    assert [r.violations for r in gates.violations(rel).collect()] == [[], ["score", "bbox", "self_pair"], ["score", "panel"]]


def test_markup(spark):
    docs = spark.createDataFrame([(1, '{"type": "page", "blocks": [{"type": "text", "text": "a"}, {"type": "list", "blocks": [{"type": "item", "text": "b"}]}]}')], "id int, j string")
    assert sorted((r.path, r.type, r.text) for r in markup.blocks(docs, "id", "j").collect()) == [("0", "page", None), ("0.0", "text", "a"), ("0.1", "list", None), ("0.1.0", "item", "b")]
    deep = '{"type": "leaf"}'
    for k in range(9):
        deep = f'{{"type": "t{k}", "blocks": [{deep}, 7]}}'
    rows = sorted((r.path, r.type) for r in markup.blocks(spark.createDataFrame([(1, deep), (2, None), (3, "no json")], "id int, j string"), "id", "j").collect())
    assert rows == [(".".join(["0"] * (k + 1)), "leaf" if k == 9 else f"t{8 - k}") for k in range(10)]
    assert markup.blocks(docs.limit(0), "id", "j").count() == 0
    lines = spark.createDataFrame([(1, 1, "| a | b |"), (1, 2, "|---|:-:|"), (1, 3, "|1|  2|"), (1, 4, "text")], "id int, line int, body string")
    assert sorted((r.line, r.col, r.body) for r in markup.pipe_cells(lines, "id").collect()) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "1"), (3, 1, "2")]


def test_ranges_buckets_and_report_ids(spark):
    rows = [("B-E", 0.5), (" 2 - 5 ", 1.5), ("b-3", float("nan")), ("A1:C9", float("-inf")), ("", 1e300), (None, None), ("see AA10:AB12,A1:A1", -2.5)]
    df = spark.createDataFrame(rows, "t string, v double")
    got = df.select(s.column_range(F.col("t")).alias("c"), s.cell_ranges(F.col("t")).alias("r"), s.value_bucket(F.col("v"), 1.0).alias("b")).collect()
    assert [r.c and tuple(r.c) for r in got] == [(2, 5), (2, 5), None, None, None, None, None]
    assert [r.r and [tuple(x) for x in r.r] for r in got] == [[], [], [], [(1, 1, 9, 3)], [], None, [(10, 27, 12, 28), (1, 1, 1, 1)]]
    assert [r.b for r in got] == [0, 2, 0, 0, None, None, -2]
    ids = spark.createDataFrame([("R-202401-0aF9bC",), ("R-202401-0aF9bC\n",), ("R-2024-0aF9bC",), ("Q-202401-000000",), (None,)], "t string")
    assert [r[0] for r in ids.select(s.is_report_id(F.col("t"), "R")).collect()] == [True, False, False, False, False]
