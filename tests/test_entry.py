"""The entry points, and the queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from marlweave.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)
    plain = lambda v: round(float(v), 5) if isinstance(v, float) else int(v) if hasattr(v, "item") and not isinstance(v, bool) and "bool" not in type(v).__name__ else str(v)
    return sorted(tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "chunk_id", "rank", "score"]
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
