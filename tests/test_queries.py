"""Every query of the library against its SQL on the smallest tables, where they are there."""

import math
import os

import duckdb
import pytest

from chronofeat import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "" if v is None else str(v)


def compare(spark, name, query, sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = query(spark, data)
    rows = df.collect()
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns), name
    at = [df.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[i]) for i in at) for r in rows) == sorted(tuple(map(plain, r)) for r in res.fetchall()), name


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_query(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
