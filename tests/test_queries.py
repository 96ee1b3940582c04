"""Every query of the catalogue against its SQL, run by DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from trawl.plans import catalog, oracles


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if hasattr(value, "as_tuple") or hasattr(value, "isoformat") else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for file in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS FROM read_parquet('{file}')")
    return con


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_equals_its_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.sql(oracles.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_all_others_run(spark, sf):
    for name in catalog.QUERIES.keys() - oracles.SQL.keys():
        assert catalog.QUERIES[name](spark, sf).count() > 0
