import os

import pytest

import __spark_entry__


def test_every_oracle_belongs_to_a_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert all(callable(f) for f in queries.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are not there")
def test_entry_has_rows(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"a_term", "b_term", "ab_count", "ratio"} <= set(rows[0].asDict())
