"""Every registered query of the library against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from sigtrellis import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([value(r[c]) for c in cols]) for r in df.collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted(repr([value(r[names.index(c)]) for c in cols]) for r in cursor.fetchall())
    assert got == want
