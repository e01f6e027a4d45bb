"""Queries that larger tables stopped: what they gave then they still give, with less work."""

import os
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import blocks, pairs, reports
from attesta.operators.runs import longest_run
from attesta.operators.shelf import shelf
from attesta.registry import QUERIES
from attesta.sources.cells import SCHEMA, from_table, packed


def jobs_of(spark, run):
    """What ``run`` returns, and how many Spark jobs it took."""
    name = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def kruskal(edges):
    above, tree = {}, set()

    def top(v):
        while above.get(v, v) != v:
            v = above[v]
        return v

    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if a != b}):
        if top(a) != top(b):
            above[top(a)] = top(b)
            tree.add((a, b, w))
    return tree


@pytest.mark.parametrize("small", [30, reports.SMALL])
def test_spanning_tree_settles_in_few_jobs(spark, small):
    rng = random.Random(8)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randrange(30))) for _ in range(200)]
    edges += [(1000 + i, 1001 + i, float(i)) for i in range(12)]  # one long path of pointers
    df = spark.createDataFrame(edges, "a int, b int, weight double")
    rows, jobs = jobs_of(spark, lambda: reports.spanning_tree(df, small=small).collect())
    assert sorted(map(tuple, rows)) == sorted(kruskal(edges))
    assert small < reports.SMALL or jobs < 30


def test_rows_kept_by_sheet_are_grouped_without_an_exchange(spark):
    """Gathered rows went to the shared folder uncompressed, and to every join by an exchange."""
    line = spark.range(600).selectExpr("id % 7 AS s", "CAST(id AS INT) AS k")
    wide = from_table(line, "w", F.col("s"), ["k"], {"x": F.col("k") * 1_000_000, "y": F.col("k") * 1_000_000 + 5})
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with shelf(spark) as keep:
        table = keep(wide)
        path = table.inputFiles()[0].removeprefix("file:")
        rows = packed(table, [F.col("x"), F.col("y")])
        assert "Exchange" not in plan(pairs.pair_stats(pairs.pairs_of(rows)))
        wanted = spark.createDataFrame([("w", "3", 1, 2)], "workbook string, sheet string, left int, right int")
        met = plan(pairs.chosen_pairs(rows, wanted, []))
        assert met.count("Exchange") <= 2 and "ShuffledHashJoin" in met  # of what is wanted only
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_relations_that_hold_on_most_rows_are_counted_by_value(spark):
    rows = [("w", s, r, c, v) for s, wrong in (("all", 0), ("most", 1), ("few", 9)) for r in range(100) for c, v in ((1, r * 37 + 11), (2, r * 37 + 11 + (5 if r >= wrong else r)))]
    found = pairs.relations(spark.createDataFrame(rows, SCHEMA), ("fixed_difference",))
    assert sorted((r.sheet, r.value, r.support, r.overlap) for r in found.collect()) == [("all", -5, 100, 100), ("most", -5, 99, 100)]


def test_gray_images_are_counted_in_their_rows(spark):
    """Pixels became rows that were grouped by image and value."""
    flat, odd = [7] * 20, [None, 300, *range(18)]
    images = spark.createDataFrame([(1, 5, 4, flat), (2, 5, 4, odd), (3, 5, 4, []), (4, 0, 4, flat)], "image_id long, width int, height int, pixels array<int>")
    found = reports.gray_anomalies(images)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "globally_uniform", "medium"), (1, "uniform_border", "high")]


def test_picture_turns_hash_each_picture_once(spark):
    plan = QUERIES["pixel_turns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # both sides read the hashes that were written


@pytest.mark.parametrize("name", ["copy_paste_modify", "shifted_paste"])
def test_pasted_findings_are_written_before_they_are_returned(spark, name):
    """The plan held the cells some thirty times, which the driver kept for each update."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_places_and_runs_of_kept_sheets_need_no_exchange(spark):
    """Cells met cells by place, and every value of every pair was a row of its own."""
    cells = spark.createDataFrame([("w", s, r, c, r * c + 1) for s in "ab" for r in range(9) for c in (1, 2)], SCHEMA)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with shelf(spark) as keep:
        table = keep(cells)
        assert "Exchange" not in plan(blocks._by_place(table, 8))
        found = longest_run(table, ["workbook", "sheet", "col"], "row", "n")
        assert "Exchange" not in plan(found)
        assert {(r.run, r.n) for r in found.collect()} == {(9, 9)}


def test_positional_relations_of_one_and_of_several_values(spark):
    rows = [("w", "s", r, c, v) for r in range(1, 11) for c, v in ((1, r * 1_000_000), (2, r * 2_000_000), (3, r * 1_000_000 + (700 if r > 1 else 0)), (4, 0))]
    found = blocks.positional_relations(spark.createDataFrame(rows, SCHEMA))
    got = {(r.left, r.right, r.kind): (r.value, r.support, r.n) for r in found.collect()}
    assert got[1, 2, "ratio"] == (20000, 10, 10) and got[1, 3, "difference"] == (7, 9, 10)
    assert (1, 2, "difference") not in got and (4, 1, "ratio") not in got
