"""Known answers on small hand-made sheets, workbooks and streams."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from attesta.operators import blocks, findings, fractions, offsets, pairs, similarity, text
from attesta.sources import files, xlsx
from attesta.streaming import events

CELL = "workbook string, sheet string, row int, col int, v long"


def cells(spark, columns):
    rows = [("w", "s", r, c, int(round(x * 1e6))) for c, values in columns.items() for r, x in values.items()]
    return spark.createDataFrame(rows, CELL)


def test_duplicate_columns_of_mostly_zeros(spark):
    a = {r: 0 for r in range(1, 50)} | {50: 1}
    b = {r: 0 for r in range(1, 50)} | {50: 2}
    found = pairs.duplicate_columns(cells(spark, {1: a, 2: b})).collect()
    assert [(r.left, r.right, r.support, r.risk_level) for r in found] == [(1, 2, 49, "low")]


def test_duplicate_columns_with_fewer_zeros(spark):
    a = {r: 0 if r <= 13 else r for r in range(1, 21)}
    found = pairs.duplicate_columns(cells(spark, {1: a, 2: a})).collect()
    assert [(r.support, r.overlap, r.risk_level) for r in found] == [(20, 20, "medium")]


def test_fixed_ratio_of_means_and_sums(spark):
    found = pairs.fixed_ratio(cells(spark, {5: {r: r for r in range(10, 20)}, 7: {r: r * 2.5 for r in range(10, 20)}})).collect()
    assert [(r.left, r.right, r.value, r.support) for r in found] == [(5, 7, 400_000, 10)]


def test_ratios_close_to_one(spark):
    base = {r: 1000 * r for r in range(1, 21)}
    found = pairs.fixed_ratio(cells(spark, {1: {r: v * 1.00004 for r, v in base.items()}, 2: base})).collect()
    assert [(r.value, r.support, r.risk_level) for r in found] == [(1_000_040, 20, "medium")]


def test_running_numbers_on_one_side_or_both(spark):
    rows = range(1, 21)
    one = pairs.fixed_difference(cells(spark, {1: {r: r for r in rows}, 2: {r: r + 0.37 for r in rows}})).collect()
    both = pairs.fixed_difference(cells(spark, {1: {r: r for r in rows}, 2: {r: r + 7 for r in rows}})).collect()
    twos = pairs.fixed_difference(cells(spark, {1: {r: 2 * r for r in rows}, 2: {r: 2 * r + 7 for r in rows}})).collect()
    assert [(r.value, r.risk_level, r.artifact_likelihood) for r in one] == [(-370_000, "medium", "unknown")]
    assert [(r.value, r.risk_level, r.artifact_likelihood) for r in both] == [(-7_000_000, "low", "high")]
    assert [(r.value, r.risk_level) for r in twos] == [(-7_000_000, "medium")]


def named(spark, labels):
    return spark.createDataFrame([("w", "s", c, text) for c, text in labels.items()], "workbook string, sheet string, col int, label string")


def test_what_labels_and_formulas_explain(spark):
    mean = {r: 1.5 * r + 0.25 for r in range(1, 13)}
    sheet = cells(spark, {1: mean, 2: {r: 4 * v for r, v in mean.items()}, 3: {r: 4 for r in mean}})
    summary = pairs.fixed_ratio(sheet, labels=named(spark, {1: "Mean", 2: "Sum", 3: "n total"})).filter("left = 1 AND right = 2").collect()
    other = pairs.fixed_ratio(sheet.withColumn("v", F.when(F.col("col") == 3, F.col("v") + 1_000_000).otherwise(F.col("v"))), labels=named(spark, {1: "Mean", 2: "Sum", 3: "n total"})).filter("left = 1 AND right = 2").collect()
    bare = pairs.fixed_ratio(sheet, labels=named(spark, {1: "Mean", 2: "Sum", 3: "dose"})).filter("left = 1 AND right = 2").collect()
    assert [(r.risk_level, r.artifact_reason) for r in summary + other + bare] == [("low", "summary statistics"), ("medium", None), ("low", "summary statistics")]
    step = {r: float(r % 3) + 0.5 for r in range(1, 13)}
    design = pairs.fixed_difference(cells(spark, {1: step, 2: {r: v + 2 for r, v in step.items()}}), labels=named(spark, {1: "Day", 2: "dose"})).collect()
    assert [(r.risk_level, r.artifact_reason) for r in design] == [("low", "time or event design")]
    formulas = spark.createDataFrame([("w", "s", 2)], "workbook string, sheet string, col int")
    formula = pairs.fixed_ratio(sheet, formulas=formulas).filter("left = 1 AND right = 2").collect()
    assert [(r.risk_level, r.artifact_likelihood) for r in formula] == [("low", "medium")]


def test_finding_ids_beyond_four_digits(spark):
    found = spark.range(12_000).select(F.lit("w").alias("workbook"), (F.col("id") % 97).cast("string").alias("sheet"), F.lit("fixed_ratio").alias("category"), F.when(F.col("id") % 5 == 0, "high").otherwise("low").alias("risk_level"), F.col("id").cast("string").alias("columns"))
    odd = found.limit(3).withColumn("category", F.lit("another"))
    rows = findings.numbered([findings.unified(found, F.col("columns")), findings.unified(odd, F.col("columns"))]).collect()
    ids = sorted((r.finding_id for r in rows if r.category == "fixed_ratio"), key=lambda x: int(x[3:]))
    assert ids == [f"FR-{k:04d}" for k in range(1, 12_001)]
    assert {r.finding_id for r in rows if r.category == "another"} == {"PF-0001", "PF-0002", "PF-0003"}
    order = sorted((r for r in rows if r.category == "fixed_ratio"), key=lambda r: (-r["rank"], r.workbook, r.sheet, r.columns))
    assert [r.finding_id for r in order] == ids


@pytest.mark.parametrize(("limit", "intact"), [(3, 1), (8, 2), (16, 1), (20, 3)])
def test_hamming_pairs_lose_none(spark, limit, intact):
    draw = random.Random(limit)
    values = [0, 0x1111111111111111, (1 << 63) - 1, -1, -1, -2, -(1 << 63)]
    for _ in range(25):
        h = draw.getrandbits(63)
        values += [h, h]
        for many in range(1, limit + 3):  # bits spread over the bands, or anywhere
            values.append(h ^ sum(1 << (63 * k // many) for k in range(many)))
            values.append(h ^ sum(1 << b for b in draw.sample(range(63), many)))
    rows = [*enumerate(values), (9999, None)]
    df = spark.createDataFrame(rows, "id int, h long")
    least = {}
    for i, h in enumerate(values):
        least.setdefault(h, i)
    apart = lambda x, y: ((x ^ y) & ((1 << 64) - 1)).bit_count()
    want = {(min(a, b), max(a, b), apart(x, y)) for x, a in least.items() for y, b in least.items() if x < y and apart(x, y) <= limit}
    assert {tuple(r) for r in similarity.hamming_pairs(df, limit, intact=intact).collect()} == want
    assert {(r.id, r.class_id) for r in similarity.classes(df).collect()} == {(i, least[h]) for i, h in enumerate(values)}


def test_row_offsets_of_a_repeated_half(spark):
    values = {1: (1, 2), 2: (2, 6), 3: (3, 12), 4: (4, 20), 5: (10, 20), 6: (20, 60), 7: (30, 120), 8: (40, 200), 20: (7, 8), 30: (7, 8)}
    sheet = cells(spark, {1: {r: v[0] for r, v in values.items()}, 2: {r: v[1] for r, v in values.items()}})
    reuse = offsets.paired_ratio_reuse(sheet, max_offset=8, least=4, support=100).collect()
    assert [(r.row_offset, r.support) for r in reuse] == [(4, 4)]
    rows = offsets.row_offset_reuse(sheet, max_offset=8, least=4, support=100).collect()
    assert [(r.category, r.row_offset, r.ratio, r.columns) for r in rows] == [("row_offset_scalar_multiple", 4, 100_000, "1,2")]
    same = blocks.duplicate_rows(sheet).collect()
    assert [(r.first_row, r.n) for r in same] == [(20, 2)]


def test_long_format_pairs(spark):
    values = [(1, 1, 2), (2, 2, 6), (3, 3, 12), (4, 4, 20), (5, 10, 20), (6, 20, 60), (7, 30, 120), (8, 40, 200)]
    rows = [("w", "s", i, 2 * i + k, int(v * 1e6)) for i, a, b in values for k, v in enumerate((a, b))]
    df = spark.createDataFrame(rows, "workbook string, sheet string, id int, row int, v long")
    found = offsets.long_format_ratio_reuse(offsets.long_pairs(df, least=4), max_offset=4, least=4, support=100).collect()
    assert [(r.row_offset, r.support, r.overlap) for r in found] == [(4, 4, 4)]


def test_blocks_parted_by_text(spark):
    part = {r: (10 * r, 100 * r) for r in range(1, 5)}
    late = {r + 5: (a + 0.01, b + 0.01) for r, (a, b) in part.items()}
    both = part | late
    sheet = cells(spark, {1: {r: v[0] for r, v in both.items()}, 2: {r: v[1] for r, v in both.items()}})
    marks = spark.createDataFrame([("w", "s", 5)], "workbook string, sheet string, row int")
    assert sorted((r.block_x, r.block_y, r.col, r.n_columns, r.n_rows) for r in blocks.cross_blocks(sheet, marks).collect()) == [(0, 1, 1, 2, 4), (0, 1, 2, 2, 4)]
    # One of two shared columns differs widely: the narrow one is reported alone.
    wide = sheet.withColumn("v", F.when((F.col("col") == 2) & (F.col("row") > 5), F.col("v") * 3).otherwise(F.col("v")))
    assert [(r.col, r.n_columns) for r in blocks.cross_blocks(wide, marks).collect()] == [(1, 2)]
    assert blocks.cross_blocks(wide.filter("col = 1"), marks).count() == 0


def test_whole_differences_need_equal_signs(spark):
    found = fractions.copy_paste_modify(cells(spark, {1: {1: -1.2, 2: -1.2, 3: -1.2}, 2: {1: 2.2, 2: 2.2, 3: 2.2}}))
    assert found.count() == 0
    found = fractions.copy_paste_modify(cells(spark, {1: {1: 1.25, 2: 3.5, 3: 4.75}, 2: {1: 4.25, 2: 6.5, 3: 7.75}})).collect()
    assert [(r.delta, r.run) for r in found] == [(3, 3)]


def book(sheets, shared=()):
    out = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    text_row = '<row r="1"><c r="A1" t="inlineStr"><is><t>Mean</t></is></c><c r="B1" t="s"><v>0</v></c></row>'
    data = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}.5</v></c><c r="B{r}"><f>A{r}*2</f><v>{2 * r + 1}</v></c><c r="AB{r}" t="b"><v>1</v></c></row>' for r in range(2, 12))
    gap = '<row r="12"><c r="A12" t="inlineStr"><is><t>x</t></is></c><c r="B12" t="inlineStr"><is><t>x</t></is></c></row><row r="13"><c r="A13"><v>NaN</v></c><c r="B13"><v>3</v></c></row>'
    (tmp_path / "one.xlsx").write_bytes(book({"Fig 1": text_row + data + gap, "Empty": ""}, ["Sum"]))
    (tmp_path / "~$one.xlsx").write_bytes(b"lock")
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    got = xlsx.read(spark, str(tmp_path))
    assert [r.workbook for r in got.filter("error IS NOT NULL").collect()] == ["bad.xlsx"]
    numbers = xlsx.numeric(got)
    assert numbers.count() == 21 and numbers.agg(F.max("col")).first()[0] == 2
    assert {r.col: r.label for r in xlsx.labels(got).collect()} == {1: "Mean / x", 2: "Sum / x"}
    assert [r.row for r in xlsx.separators(got).collect()] == [12]
    assert [(r.col, r.n, r.pattern, r.risk_level) for r in xlsx.formulas(got).collect()] == [(2, 10, "A<row>*2", "high")]
    assert [(r.left, r.right, r.value) for r in pairs.fixed_ratio(numbers, support=85).collect()] == [(1, 2, 500_000)]
    kinds = {r.type: r.n for r in files.inventory(spark, str(tmp_path)).groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"source_data": 3}


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("dataset, metric, value\nd, m, 1\nd, m, x\n, m, 2\n")
    claims = spark.createDataFrame([(1, "d", "m", 1.0, 0.1), (2, "d", "other", 1.0, 0.1)], "id int, dataset string, metric string, expected double, tolerance double")
    got = text.reconcile_claims(claims, files.result_map(spark, str(tmp_path / "r.csv"))).collect()
    assert {r.id: r.status for r in got} == {1: "unparsed", 2: "missing"}
    (tmp_path / "panels.csv").write_text("FIGNAME, ID, LABEL\nfig1, 1, a\nfig1, 2, b\nother, 1, a\n")
    figures = spark.createDataFrame([("F1", "x/fig1.png"), ("F2", "x/y.fig2.png")], "figure_id string, path string")
    assert sorted((r.figure_id, r.ID, r.LABEL) for r in files.panel_csv(spark, str(tmp_path / "panels.csv"), figures).collect()) == [("F1", "1", "a"), ("F1", "2", "b")]
    (tmp_path / "p.png").write_bytes(b"abc")
    assert [(r.path.rsplit("/", 1)[1], r.digest[:8]) for r in files.images(spark, str(tmp_path)).collect()] == [("p.png", "ba7816bf")]
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert files.tolerant_log(spark, str(tmp_path / "log.jsonl"), "a int").count() == 2
    made = []
    build = lambda: made.append(1) or spark.range(3)
    for force in (False, False, True):
        assert files.artifact(spark, str(tmp_path / "t"), build, force).count() == 3
    assert len(made) == 2


def test_grades(spark):
    runs = spark.createDataFrame([("a", "discover", "failed"), ("b", "source_data_scan", "failed"), ("c", "report", "failed"), ("d", "parse", "done")], "case_id string, step string, status string")
    risks = spark.createDataFrame(
        [("c", "high", "fixed_ratio", "consistency"), ("d", "low", "fixed_ratio", "consistency"), ("e", "high", "fixed_ratio", "other"), ("f", "low", "paperfraud.methodology_review", "other"), ("g", "critical", "x", "completeness"), ("h", "high", "statistical_test", "other")],
        "case_id string, risk_level string, category string, issue_category string",
    )
    assert {r.case_id: r.grade for r in findings.grade(runs, risks, "full").collect()} == {"a": "D", "b": "B", "c": "C", "d": "A", "e": "A", "f": "B", "g": "B", "h": "B"}
    assert {r.grade for r in findings.grade(runs, risks, "static").collect()} == {"C", "D"}
    with pytest.raises(ValueError, match="unknown tier"):
        findings.grade(runs, risks, "gold")


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in similarity.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_spanning_tree_against_kruskal(spark):
    from attesta.operators import reports

    draw = random.Random(7)
    edges = [(draw.randrange(60), draw.randrange(60), float(draw.randrange(6))) for _ in range(150)] + [(100, 101, 1.0), (5, 5, 0.0), (7, None, 1.0)]
    got = [tuple(r) for r in reports.spanning_tree(spark.createDataFrame(edges, "a int, b int, weight double")).collect()]
    root = {v: v for e in edges for v in e[:2]}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    want = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if b is not None and a != b):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, w))
    assert sorted(got) == sorted(want)
    assert reports.spanning_tree(spark.createDataFrame([], "a int, b int, weight double")).count() == 0


def test_streams(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), batch.schema)
    query = events.write_latest(events.tumbling(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = events.tumbling(batch)
    # The last windows stay open until the watermark passes them.
    assert 0 < got.count() <= want.count()
    assert got.join(want.select("window_start", "event_type", F.col("n").alias("m")), ["window_start", "event_type"]).filter("n = m").count() == got.count()
    assert events.replay(batch, "x").count() == 0
