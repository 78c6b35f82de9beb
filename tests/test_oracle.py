"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from relkit.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return round(v, 9) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLES[name])
    wanted = rows([d[0] for d in result.description], result.fetchall())
    assert found == wanted


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
