"""Verdicts on patterns and findings: what has none, several, or an unknown one."""

from attesta.operators import verdicts as ops

FINDING = "finding_id string, category string, workbook string, sheet string, risk_level string, issue_category string"
VERDICT = "category string, workbook string, sheet string, seq int, verdict string, confidence double, priority string, explanation string, benign_pattern string"


def findings(spark):
    rows = [
        ("A-1", "a", "w", "s", "high", "completeness"), ("A-2", "a", "w", "t", "LOW", "consistency"), ("B-1", "b", "w", "s", "medium", "Consistency"),
        ("C-1", "c", "w", None, "critical", None), ("C-2", "c", None, None, "odd", "matching"), ("D-1", "d", "w", "s", "High", "matching"),
    ]
    return spark.createDataFrame(rows, FINDING)


def test_expansion(spark):
    given = [
        ("a", "w", "s", 1, "false_positive", 0.5, "low", "first", None), ("a", "w", "s", 2, "true_positive", None, None, None, "dilution"),
        ("b", "w", "s", 1, "nonsense", 0.1, "low", "x", None), ("c", "w", None, 1, "false_positive", 1.0, "low", "never met", None),
    ]
    table = spark.createDataFrame(given, VERDICT)
    priorities = spark.createDataFrame([("b", "critical"), ("a", "urgent"), (None, "high")], "category string, review_priority string")
    judged = ops.expanded(findings(spark), table, priorities)
    got = {r.finding_id: r for r in judged.collect()}
    assert len(got) == 6
    assert (got["A-1"].verdict, got["A-1"].confidence, got["A-1"].priority, got["A-1"].explanation, got["A-1"].benign_pattern) == ("true_positive", 0.0, "medium", "", "dilution")
    assert (got["B-1"].verdict, got["B-1"].priority) == ("nonsense", "critical")
    assert all(got[i].verdict == "uncertain" and got[i].priority == "medium" for i in ("A-2", "C-1", "C-2", "D-1"))
    counts = {r.category: tuple(r)[1:] for r in ops.by_category(judged, priorities).collect()}
    assert counts == {"a": (1, 0, 1, "medium"), "b": (0, 0, 1, "critical"), "c": (0, 0, 2, "medium"), "d": (0, 0, 1, "medium")}
    sheets = spark.createDataFrame([("w", "s", "ok"), ("w", "t", "failed"), ("w", "u", None)], "workbook string, sheet string, status string")
    assert ops.totals(judged, sheets).first().asDict() == {"total_sheets": 3, "failed_sheets": 1, "total_findings": 6, "true_positive": 1, "false_positive": 0, "uncertain": 5}
    empty = ops.totals(judged.limit(0), sheets.limit(0)).first().asDict()
    assert set(empty.values()) == {0}


def test_split_and_top(spark):
    verdicts = spark.createDataFrame([("A-1", 1, "true_positive", 1.0, "x"), ("A-1", 2, "false_positive", None, None), ("B-1", 1, None, None, "y"), (None, 1, "false_positive", 1.0, "z")], "finding_id string, seq int, verdict string, confidence double, explanation string")
    certainty = spark.createDataFrame([("A-1", 1, "old", "i", "s"), ("A-1", 2, "new", None, "s")], "finding_id string, seq int, fact string, inference string, suggestion string")
    f = findings(spark).selectExpr("*", "'clash' AS verdict", "true AS active")
    got = {r.finding_id: r for r in ops.report_split(f, verdicts, certainty).collect()}
    assert {i for i, r in got.items() if not r.active} == {"A-1"} and len(got) == 6
    assert (got["A-1"].fact, got["A-1"].inference, got["A-1"].confidence) == ("new", "", 0.0)
    assert (got["B-1"].verdict, got["B-1"].fact, got["C-1"].verdict) == ("uncertain", None, None)
    top = ops.top_findings(findings(spark), 3).orderBy("place").collect()
    assert [r.finding_id for r in top] == ["B-1", "D-1", "A-1"]


def test_task_details(spark):
    rows = [("a", "w", "s", k, f"offset={k};x", 2 + k % 3, 3, f"A-{2 * k:04d},A-{2 * k + 1:04d}") for k in range(20)] + [("b", "w", "s", None, "offset=-", 900, 2, "B-1")]
    clusters = spark.createDataFrame(rows, "category string, workbook string, sheet string, row_offset int, signature string, size long, rank int, representatives string")
    first, second = ops.task_details(clusters).orderBy("task_id").collect()
    order = sorted(rows[:20], key=lambda r: (-r[5], r[4], r[3]))
    assert (first.task_id, first.category, first.priority, first.n_clusters, first.n_findings) == ("PFRT-001", "a", "high", 20, sum(r[5] for r in rows[:20]))
    assert first.signatures.split(",") == [r[4] for r in order[:12]]
    assert first.representatives.split(",") == ",".join(r[7] for r in order).split(",")[:12]
    assert (second.task_id, second.representatives, second.priority) == ("PFRT-002", "B-1", "medium")
