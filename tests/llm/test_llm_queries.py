"""The queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from lectern.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark):
    df = queries.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == names
    rows = lambda xs, get: sorted(repr([get(x, c) for c in names]) for x in xs)
    assert rows(df.collect(), lambda r, c: r[c]) == rows(cur.fetchall(), lambda r, c: r[at.index(c)])


def test_all_are_there():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs_over_the_whole_table(name, spark):
    df = queries.QUERIES[name](spark, FOLDER)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id for r in documents.select("doc_id").collect()}
    got = [r.doc_id for r in df.collect()]
    assert got and set(got) <= ids
    if name != "op2_decontamination":  # one row for each pair of a document and an item
        assert set(got) == ids
