"""Every reference query against its DuckDB form at the smallest scale."""

import datetime

import duckdb
import pytest

from quillspark.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(columns, names, values):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert rows(columns, df.columns, df.collect()) == rows(columns, names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_return_rows(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0
