"""Rule bases from files against a plain loop, and what many rules cost."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from attesta.operators import rules as ops
from attesta.sources import rules as source

BASE = {
    "type": "statistics",
    "category": "design",
    "rules": [
        {"id": "R1", "severity": "red", "detection": {"triggers": {"keywords": ["P Value", {"pattern": r"n\s*=\s*\d", "type": "regex"}], "negative_triggers": ["corrected"]}}, "evidence_template": "says {excerpt} {other}"},
        {"detection": {"triggers": {"study_types": ["rct", "in the field"]}, "negative_triggers": ["blinded"]}},
        {"id": "R3", "enabled": False, "detection": {"triggers": {"keywords": ["the"]}}},
        {"id": "R4", "detection": {"triggers": {"keywords": [{"pattern": "(", "type": "regex"}, "", "ΟΔΟΣ", "İx"]}}},
    ],
}
TEXTS = [
    (1, "A small P\nvalue; p value 0.04 in n = 12 mice"), (2, "p VALUE, corrected"), (3, "A randomised trial, n=5"), (4, "In the Field, but blinded"), (5, ""), (6, None),
    (7, "İİ p value " * 3), (8, "οδος and οδοσ"), (9, "x" * 300_000 + " p value"), (1, "p value"),
]


def plain(rules, text):
    """Rules met, each searched by itself."""
    kinds = {**ops.STUDIES, "in the field": "in the field"}
    for r in rules:
        hits = [m for k in r["keywords"] if k["pattern"] and k["pattern"] != "(" and (m := re.search(k["pattern"] if k["type"] == "regex" else re.escape(k["pattern"]), text, re.I))]
        if not text or not r["enabled"] or (r["keywords"] and not hits) or (r["study_types"] and not any(re.search(kinds[s], text, re.I) for s in r["study_types"])) or any(re.search(re.escape(n), text, re.I) for n in r["negatives"]):
            continue
        yield r["rule_id"], [text[max(0, m.start() - 60) : m.end() + 60].replace("\n", " ").strip() for m in hits]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("rules")
    (path / "good.json").write_text(json.dumps(BASE), encoding="utf-8")
    (path / "broken.json").write_text("{", encoding="utf-8")
    (path / "list.json").write_text("[1]", encoding="utf-8")
    (path / "empty.json").write_text("null", encoding="utf-8")
    (path / "half.json").write_text('{"rules": [{"id": "H"}, 3]}', encoding="utf-8")
    return path


def test_files(spark, folder):
    rules, errors = source.read_rules(spark, str(folder))
    found = {r.rule_id: r for r in rules.collect()}
    assert sorted(found) == ["R1", "R3", "R4", "good.unknown"]
    assert (found["R1"].category, found["R1"].rule_type, found["good.unknown"].severity, found["R3"].enabled) == ("design", "statistics", "yellow", False)
    assert sorted(r.path.rsplit("/", 1)[-1] for r in errors.collect()) == ["broken.json", "half.json", "list.json"]
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string").withColumn("severity", F.lit("clash"))
    got = sorted((r.doc_id, r.rule_id, r.excerpts) for r in ops.match(docs, rules).collect())
    every = [r.asDict(recursive=True) for r in rules.collect()]
    assert got == sorted((k, i, e) for k, t in TEXTS for i, e in plain(every, t or ""))
    assert {(k, i) for k, i, _ in got} == {(1, "R1"), (3, "R1"), (3, "good.unknown"), (7, "R1"), (8, "R4"), (9, "R1")}
    evidence = ops.match(docs.filter("doc_id = 3"), rules).filter("rule_id = 'R1'").first().evidence
    assert evidence == "says A randomised trial, n=5 {other}"


def test_yaml(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "good.yaml").write_text(yaml.safe_dump(BASE, allow_unicode=True), encoding="utf-8")
    (tmp_path / "bad.yaml").write_text("rules: [", encoding="utf-8")
    rules, errors = source.read_rules(spark, str(tmp_path))
    assert rules.count() == 4 and errors.count() == 1


def test_annotations_and_standards(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"claims": [{"claim_type": "visual", "target": "Fig. 1"}, {"claim_type": "visual"}], "checklist": [{"item": 1}, "two"]}), encoding="utf-8")
    claims, errors = source.read_annotations(spark, str(tmp_path))
    assert [tuple(r) for r in claims.collect()] == [("visual", "Fig. 1", "", "image", "manual_annotation", True)] and not errors.collect()
    assert [tuple(r) for r in source.read_standards(spark, str(tmp_path))[0].orderBy("place").collect()] == [("a", 1, '{"item": 1}'), ("a", 2, '"two"')]


def test_methods_and_bounds(spark, folder):
    rules, _ = source.read_rules(spark, str(folder))
    docs = spark.createDataFrame([(1, "A randomised trial", "a cohort"), (2, "nothing", "a clinical trial"), (3, None, "in the field")], "doc_id int, text string, methods string")
    assert sorted((r.doc_id, r.rule_id) for r in ops.match(docs, rules, methods_col="methods").collect()) == [(2, "good.unknown"), (3, "good.unknown")]
    assert not ops.match(docs.limit(0), rules).collect() and not ops.match(docs, rules.limit(0)).collect()
    with pytest.raises(ValueError):
        ops.match(docs, rules, max_bytes=10)


def test_many_rules_cost_one_pass():
    rule = lambda k: {"rule_id": f"r{k}", "severity": "red", "keywords": [{"pattern": f"word {k} of", "type": "keyword"}], "negatives": [f"never {k}"], "study_types": [], "evidence_template": ""}
    text = "many a word 7 of the text and others. " * 20_000

    def seconds(n):
        matcher, best = ops.Matcher([rule(k) for k in range(n)]), []
        for _ in range(3):
            start = time.perf_counter()
            assert [r["rule_id"] for r, _ in matcher.matches(text, "")] == ["r7"]
            best.append(time.perf_counter() - start)
        return min(best)

    assert seconds(1000) < 3 * seconds(8)
