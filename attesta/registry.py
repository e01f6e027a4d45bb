"""Every registered query of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.plans import blocks, copies, evidence, findings, geometry, images, relations, reports, reviews, rules, runs, texts, verdicts, workbooks

_MODULES = (findings, relations, blocks, texts, reviews, reports, runs, workbooks, geometry, copies, evidence, images, rules, verdicts)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
