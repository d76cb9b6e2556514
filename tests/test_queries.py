"""Every query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from larkwing.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", ["choice_census", "sample_uniform_wor", "sample_weighted_wr", "mnl_scores", "nested_probabilities", "scl_probabilities", "simulate_independent", "graph_edges_allocation", "distance_bands"])
def test_query_is_its_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    q = c.execute(SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(str, (plain(r[n]) for n in names))) for r in df.collect()) == sorted(tuple(map(str, map(plain, r))) for r in q.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 3 and set(entry.oracle_sql()) <= set(entry.queries())
