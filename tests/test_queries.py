"""Every registered query against its SQL, on the smallest data set."""

from __future__ import annotations

import duckdb
import pytest

from strandlake.plans import registry
from tests.conftest import SF

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str)
    assert got == want


def test_flagship(spark):
    assert registry.flagship(spark, str(SF)).count() == 1
