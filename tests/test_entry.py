"""Every engine query that has SQL, against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cairn.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


def same(spark_df, cursor):
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(spark_df.columns)
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in spark_df.collect())
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    assert a == b


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck.execute(SQL[name]))


def test_dollars_of_prices_between_two_decimals(spark, tmp_path):
    prices = [350.0 * n for n in range(3, 200)] + [70000.0 * n + 35000 for n in range(1, 8)] + [12.345, 1.015, 0.0, -0.0, -350.0, 1e23, 1e30, math.inf, math.nan, None]
    spark.createDataFrame([(i, p) for i, p in enumerate(prices, 1)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    same(QUERIES["human_dollars"](spark, str(tmp_path)), c.execute(SQL["human_dollars"]))


def test_contract(spark):
    assert entry.entry(spark).columns == ["rank", "name", "objects", "bytes", "size", "cost", "monthly"]
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) == set(QUERIES)
