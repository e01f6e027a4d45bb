"""Every registered query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from attesta.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose rows another query's are made of, and which are compared with it.
WITHIN = {"every_finding", "workbook_analysis"}
#: Queries that must find something on the smallest tables, to be worth comparing.
EMPTY = {"shifted_paste"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return round(float(v), 9) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted({*SQL} - WITHIN))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want
    assert got or name in EMPTY
