"""Every query of the intent library against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from intentloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, db, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    expected = db.sql(registry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    assert plain(tuple(r) for r in found.select(*columns).collect()) == plain(expected.select(*columns).fetchall())
