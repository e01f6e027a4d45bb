"""Rule bases, reporting checklists and annotations in YAML or JSON files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = (
    "rule_id string, category string, subcategory string, title string, severity string, rule_type string, description string, "
    "keywords array<struct<pattern:string,type:string>>, negatives array<string>, study_types array<string>, "
    "evidence_template string, human_review string, references array<string>, source string, enabled boolean"
)
ANNOTATION = "claim_type string, target string, description string, evidence_type string, source string, confirmed_by_human boolean"
ITEM = "standard string, place int, item string"


def _parsed(name: str, content: bytes) -> dict:
    """The mapping that a file holds; JSON needs no YAML library."""
    text = bytes(content).decode("utf-8")
    if name.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml  # optional; without it a YAML file is an error row

        found = yaml.safe_load(text)
    found = found or {}
    if not isinstance(found, dict):
        raise ValueError("the file holds no mapping")
    return found


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _texts(value: object) -> list[str]:
    return [_text(v) for v in value] if isinstance(value, list) else []


def _mapping(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _rules(name: str, base: dict) -> list[tuple]:
    stem = name.rsplit(".", 1)[0]
    rows = []
    for rule in base.get("rules") or []:
        detection = _mapping(rule.get("detection"))
        triggers = _mapping(detection.get("triggers"))
        words = [{"pattern": k, "type": "keyword"} if isinstance(k, str) else {"pattern": _text(_mapping(k).get("pattern")), "type": _text(_mapping(k).get("type", "keyword"))} for k in triggers.get("keywords") or []]
        negatives = _texts(triggers.get("negative_triggers")) or _texts(detection.get("negative_triggers"))
        field = lambda key, default="", rule=rule: _text(rule.get(key, default))
        rows.append((
            field("id", f"{stem}.unknown"), field("category", base.get("category", "")), field("subcategory"), field("title"), field("severity", "yellow"), field("type", base.get("type", "methodology_review")), field("description"),
            words, negatives, _texts(triggers.get("study_types")), field("evidence_template"), field("human_review"), _texts(rule.get("references")), field("source", name), bool(rule.get("enabled", True)),
        ))
    return rows


def _annotations(_name: str, base: dict) -> list[tuple]:
    claims = [c for c in base.get("claims") or [] if c.get("claim_type") and c.get("target")]
    return [(_text(c["claim_type"]), _text(c["target"]), _text(c.get("description")), _text(c.get("evidence_type", "image")), "manual_annotation", bool(c.get("confirmed_by_human", True))) for c in claims]


def _checklist(name: str, base: dict) -> list[tuple]:
    return [(name.rsplit(".", 1)[0], k + 1, json.dumps(item, ensure_ascii=False, sort_keys=True, default=str)) for k, item in enumerate(base.get("checklist") or [])]


def _read(spark: SparkSession, path: str, schema: str, rows_of: Callable[[str, dict], list[tuple]]) -> tuple[DataFrame, DataFrame]:
    """Rows of all .yaml, .yml and .json files below ``path``, and (path, error) of the
    files that couldn't be read: a broken file takes no other one with it, and a file that
    breaks half-way gives no rows. Files are read by tasks, one at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yaml,yml,json}").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                name = file.rsplit("/", 1)[-1]
                try:
                    found, error = rows_of(name, _parsed(name, content)), None
                except Exception as e:  # noqa: BLE001 - any fault of a file is its own error row
                    found, error = [], f"{type(e).__name__}: {e}"
                names = [c.strip().split(" ")[0] for c in _columns(schema)]
                yield pd.DataFrame({"path": [file], "error": [error], "rows": [[dict(zip(names, r, strict=True)) for r in found]]})

    struct = ",".join(f"{c.strip().split(' ', 1)[0]}:{c.strip().split(' ', 1)[1]}" for c in _columns(schema))
    read = files.mapInPandas(run, f"path string, error string, rows array<struct<{struct}>>")
    return read.select(F.explode("rows").alias("r")).select("r.*"), read.filter("error IS NOT NULL").select("path", "error")


def _columns(schema: str) -> list[str]:
    """The parts of a schema between commas outside of angle brackets."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[last:i])
            last = i + 1
    return [*parts, schema[last:]]


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules of a rule base, as ``RULE``, and its broken files. A file's ``type`` and
    ``category`` stand in for its rules'; a rule without an id gets the file's name."""
    return _read(spark, path, RULE, _rules)


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Hand-written claims that have a type and a target, and broken files."""
    return _read(spark, path, ANNOTATION, _annotations)


def read_standards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(standard, place, item as JSON) of checklists, one standard a file; broken files."""
    return _read(spark, path, ITEM, _checklist)
