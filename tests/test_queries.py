"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

import attestor.plans.evidence
import attestor.plans.queries_jobs
import attestor.plans.queries_scores
import attestor.plans.queries_text
from attestor.plans.registry import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="the tables are not there")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(PATH):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{PATH}/{name}')")
    return con


def plain(rows):
    def one(x):
        return f"{x + 0.0:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, PATH)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    found = oracle.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = found.fetchall()
    assert plain(tuple(r[c] for c in columns) for r in rows) == plain(want)
