"""Hashes from pixels against a plain loop over exact fractions, evidence of odd rows."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from attesta.operators import copy_move, evidence, images, ranks


def turned(rows):
    """The picture a quarter counter-clockwise."""
    return [list(c) for c in zip(*rows)][::-1]


def plain_hash(rows):
    h, w = len(rows), len(rows[0])

    def mean(y, x):
        top, bottom, left, right = Fraction(y * h, 8), Fraction((y + 1) * h, 8), Fraction(x * w, 9), Fraction((x + 1) * w, 9)
        total = Fraction(0)
        for r in range(h):
            for c in range(w):
                dy, dx = min(r + 1, bottom) - max(r, top), min(c + 1, right) - max(c, left)
                if dy > 0 and dx > 0:
                    total += rows[r][c] * dy * dx
        return total

    bits = 0
    for y in range(8):
        line = [mean(y, x) for x in range(9)]
        for a, b in zip(line, line[1:]):
            bits = bits << 1 | (a > b)
    return bits - (1 << 64) if bits >> 63 else bits


def test_hashes(spark):
    draw = random.Random(5)
    pictures = {k: [[draw.randrange(256) for _ in range(draw.choice([w]))] for _ in range(h)] for k, (w, h) in enumerate([(9, 8), (1, 1), (3, 2), (20, 13), (8, 30), (17, 9)])}
    rows = [(k, len(p[0]), len(p), [v for line in p for v in line]) for k, p in pictures.items()]
    odd = [(100, None, 3, [1, 2, 3]), (101, 2, 2, None), (102, 2, 2, [1, 2, 3]), (103, 2, 1, [1, None]), (104, 0, 0, []), (105, -1, -1, [4])]
    df = spark.createDataFrame(rows + odd, "image_id int, width int, height int, pixels array<int>")
    got = {r[0]: r[1] for r in df.select("image_id", images.rotated_hashes(F.col("width"), F.col("height"), F.col("pixels"))).collect()}
    assert all(got[k] is None for k, *_ in odd)
    for k, p in pictures.items():
        want = []
        for _ in range(4):
            want.append(plain_hash(p))
            p = turned(p)
        assert got[k] == want


def test_best_rotation(spark):
    draw = random.Random(6)
    rows = [([draw.getrandbits(63) for _ in range(4)], [draw.getrandbits(63) for _ in range(4)]) for _ in range(50)]
    rows.append((rows[0][0], rows[0][0][1:] + rows[0][0][:1]))
    got = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select(images.best_rotation(F.col("a"), F.col("b")).alias("m")).select("m.*").collect()
    for (a, b), r in zip(rows, got):
        best = min(((x ^ y).bit_count(), i, k) for i, x in enumerate(a) for k, y in enumerate(b))
        assert (r.distance, r.angle) == (best[0], (best[1] - best[2]) * 90 % 360)


def test_kinds(spark):
    rows = [(1, 31, 10, [0] * 310), (2, 30, 10, [0x3030C0] * 80 + [0xFFFFFF] * 220), (3, 10, 10, [0x808080] * 100), (4, 0, 5, []), (5, 2, 2, None), (6, None, 2, [1])]
    got = images.panel_kinds(spark.createDataFrame(rows, "image_id int, width int, height int, pixels array<int>")).collect()
    assert {(r.image_id, r.kind) for r in got} == {(1, "Graph"), (2, "Microscopy")}


def test_places(spark):
    rows = [(g, v) for g in ("a", None, "b") for v in (3, 1, 2, None)] + [("hot", v) for v in range(500)]
    got = ranks.placed(spark.createDataFrame(rows, "g string, v int").repartition(7), ["v"], ["g"]).collect()
    assert sorted((r.g or "", -1 if r.v is None else r.v, r.place) for r in got) == sorted([(g or "", v, k + 1) for g in ("a", None, "b") for k, v in enumerate([-1, 1, 2, 3])] + [("hot", v, v + 1) for v in range(500)])


def test_copies_of_odd_rows(spark):
    singles = spark.createDataFrame(
        [(1, True, True, 400, "", "m/a.tif", 2, None), (2, True, True, None, "x.png", None, 1, None), (3, False, True, 300, "x.png", None, 1, "broken"), (4, None, True, 300, "x.png", None, 1, None), (5, True, True, 100, None, None, None, None), (5, True, True, 100, None, None, None, None)],
        "panel_id int, success boolean, found boolean, keypoints int, matches_path string, mask_path string, n_clusters int, error string",
    )
    crosses = spark.createDataFrame([], "source int, target int, success boolean, found boolean, keypoints int, shared_source double, shared_target double, n_source int, n_target int, matches_path string, flipped boolean, error string")
    rotations = spark.createDataFrame([(7, 8, True, True, 9, 0.9, [1.0], 90.0, None, True, None), (7, 8, True, True, 10, 0.75, [1.0], None, None, None, None)], "source int, target int, success boolean, found boolean, inliers int, score double, matrix array<double>, angle double, scale double, flipped boolean, error string")
    types = copy_move.figure_types(spark.createDataFrame([(7, "Blots"), (7, "Body"), (8, "Body"), (8, ""), (None, "Flow")], "figure_id int, panel_type string"))
    got = copy_move.relationships(singles, crosses, rotations, types, least=5, top=2).orderBy("relationship_id").collect()
    assert [(r.relationship_id, r.source, r.score, r.overlay_path, r.reported) for r in got] == [("IR-0001", "1", 1.0, "m/rel_0000_overlay.tif", True), ("IR-0002", "7", 0.75, None, True), ("IR-0003", "5", 0.5, None, False), ("IR-0004", "5", 0.5, None, False)]
    assert (got[1].source_panel_type, got[1].target_panel_type, got[1].matched_panel_types, got[1].scale, got[1].flip_detected) == ("Blots,Body", "Body", "Body", 1.0, False)
    assert [tuple(r) for r in copy_move.failures(singles, crosses, rotations).collect()] == [("single", "3", "3", "broken")]


def test_evidence_of_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    found = none("case_id long, seq long, finding_id string, workbook string, sheet string, columns string, row_offset int, support long, overlap long")
    artifacts = spark.createDataFrame([(1, "full.md", "w/full.md", 3), (1, "notes.txt", "w/notes.txt", 3), (None, "full.md", "x", 1)], "case_id long, name string, path string, bytes long")
    items = evidence.items(artifacts, none("case_id long, seq long, figure_id string, path string, label string, page int"), none("case_id long, seq long, panel_id string, figure_id string, path string, label string"), found, found)
    assert [(r.case_id, r.evidence_id, r.kind, r.name) for r in items.collect()] == [(1, "EV-ART-0001", "output_artifact", "full.md")]
    assert [tuple(r) for r in evidence.indexes(items).collect()] == [(1, "artifact", "full.md", "EV-ART-0001")]
    findings = none("case_id long, finding_id string, category string, source string, risk_level string, workbook string, sheet string, issue_category string, support long")
    refs = evidence.mentions(none("case_id long, claim_id string, ref string"), "claim_id")
    groups, members = evidence.pattern_groups(findings, refs, refs)
    assert not groups.collect() and not members.collect() and not evidence.evidence_clusters(findings, refs, refs).collect()


def test_groups_name_whole_ids(spark):
    findings = spark.createDataFrame([(1, "FR-0001", "fixed_ratio", None, None, "w", "s", "consistency", None), (1, "DRV-0001", "duplicate_row_vector", "", "high", "w", "s", None, 9), (1, None, None, None, "odd", None, None, None, 1)], "case_id long, finding_id string, category string, source string, risk_level string, workbook string, sheet string, issue_category string, support long")
    claims = evidence.mentions(spark.createDataFrame([(1, "c1", '{"ref": "FR-0001, DRV-0001"}'), (1, "c2", "FR-00011"), (1, "c1", "FR-0001"), (2, "c3", "FR-0001"), (1, "c4", None)], "case_id long, claim_id string, ref string"), "claim_id")
    groups, members = evidence.pattern_groups(findings, claims, claims)
    assert {(r.pattern_id, r.pattern_key, r.risk_level, r.n_claims, r.primary) for r in groups.collect()} == {("P-001", "row_vector_reuse", "context", 1, False), ("P-002", "formula_derivation", "medium", 1, False), ("P-003", "other", "info", 0, False)}
    assert members.count() == 3
    got = evidence.evidence_clusters(findings, claims, claims).orderBy("cluster_id").collect()
    assert [(r.cluster_id, r.workbook, r.sheet, r.risk_level, r.n_findings, r.n_claims, r.signals) for r in got] == [("EC-001", "w", "s", "medium", 2, 1, "FR-0001,DRV-0001"), ("EC-002", "-", "-", "info", 1, 0, "")]
