from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["overview_cardinality", "exact_dup_groups", "iqr_outliers", "fd_single", "cl_confident_joint", "consistency_score", "hist_entropy"])
def test_query_like_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(r)) for r in cursor.fetchall())
    got = sorted(repr(tuple(r)) for r in entry.queries()[name](spark, DATA).select(*names).collect())
    assert got == want
