"""Every query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tickloom.plans import catalogue

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{AT}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canonical(rows):
    return sorted(tuple("NULL" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, AT)
    columns = sorted(df.columns)
    got = canonical(tuple(r) for r in df.select(*columns).collect())
    assert got
    if name in catalogue.ORACLE:
        assert got == canonical(duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE[name]})").fetchall())
