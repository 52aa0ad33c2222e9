"""Every query of the engine against its SQL, on the smallest test tables."""

import math

import duckdb
import pytest

from noteloom.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        yield con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else str(value)


def compare(spark, con, run, sql):
    got = run(spark, SF)
    names = sorted(got.columns)
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    assert sorted(found) == names
    want = sorted(str(tuple(plain(r[found.index(c)]) for c in names)) for r in cursor.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in names)) for r in got.collect()) == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, tables, name):
    compare(spark, tables, catalog.QUERIES[name], catalog.ORACLES[name])
