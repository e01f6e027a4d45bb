import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import pivots

SCHEMA = "vec_id long, embedding array<double>"
EVERY = "id % 20 = 0"


def exact(rows, k):
    """(query_id, vec_id, distance) lists of the rows (id, vector), by plain loops."""
    out = {}
    for i, (qid, q) in enumerate(rows):
        if qid % 20:
            continue
        far = sorted((float(np.sqrt(((v - q) ** 2).sum())), vid) for j, (vid, v) in enumerate(rows) if j != i)
        out.setdefault(qid, []).append(far[:k])
    return out


def found(df, **how):
    out = {}
    for r in sorted(pivots.search(df, F.expr(EVERY), **how).collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id, r["rank"]))
    return out


@pytest.mark.parametrize("kind", ["sphere", "clusters", "crowd"])
def test_recall_against_brute_force(spark, kind):
    draw = np.random.default_rng(4)
    n = 3000
    vecs = draw.normal(size=(n, 32))
    if kind == "clusters":
        vecs = vecs * 0.1 + draw.normal(size=(30, 32))[draw.integers(0, 30, n)]
    if kind == "crowd":  # a third of the rows are near copies of one vector
        vecs[::3] = vecs[0] + draw.normal(size=(n // 3, 32)) * 1e-3
    rows = [(i, v) for i, v in enumerate(vecs)]
    got = found(spark.createDataFrame([(i, v.tolist()) for i, v in rows], SCHEMA))
    hits = total = 0
    for qid, (want,) in exact(rows, 10).items():
        assert [x[2] for x in got[qid]] == [*range(1, 11)]
        assert [x[:2] for x in got[qid]] == sorted(x[:2] for x in got[qid])
        hits += len({x[1] for x in got[qid]} & {x[1] for x in want})
        total += len(want)
    assert hits / total >= 0.9


def test_ties_repeats_and_odd_rows(spark):
    copies = [(i, [1.0, 2.0]) for i in range(200)]
    odd = [(1000, None), (1020, [0.0, 0.0]), (1040, [float("nan"), 1.0]), (1060, [None, 1.0]), (1080, [float("inf"), 1.0]), (1100, [1.0]), (1120, []), (None, [1.0, 2.0])]
    twins = [(2000, [5.0, 5.0]), (2000, [5.0, 5.0])]
    df = spark.createDataFrame([*copies, *odd, *twins], SCHEMA).withColumn("row", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("id", F.lit(0))
    got = found(df)
    assert sorted(got) == [*range(0, 200, 20), 2000]
    for qid in range(0, 200, 20):
        assert [x[1] for x in got[qid]] == [i for i in range(12) if i != qid][:10]
        assert {x[0] for x in got[qid]} == {0.0}
    # Each of the twins asks, and finds the other one first.
    assert sorted(got[2000])[:2] == [(0.0, 2000, 1), (0.0, 2000, 1)]
    assert len(got[2000]) == 20
    assert found(df, block_bytes=16) == got


def test_small_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(0, [1.0, 0.0])], SCHEMA)) == {}
    assert found(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], SCHEMA)) == {0: [(2**0.5, 1, 1)]}
