"""Every query with SQL gives what DuckDB gives, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if not k.startswith("op")))
def test_query(spark, con, name):
    df = __spark_entry__.queries()[name](spark, D)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = ordered(tuple(map(plain, r)) for r in found.fetchall())
    assert ordered(tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[:2] == ["copy_source", "original_source"]
