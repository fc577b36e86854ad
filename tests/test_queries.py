"""Every query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from sparkprep import queries as tabular

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, "n" if isinstance(x, (int, float)) else str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(tabular.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf, name):
    frame = tabular.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    found = duck.sql(tabular.oracle_sql()[name])
    at = [found.columns.index(c) for c in columns]
    want = ordered(tuple(r[i] for i in at) for r in found.fetchall())
    assert ordered(tuple(r[c] for c in columns) for r in frame.collect()) == want
