"""Every query of the catalog against its SQL, on the smallest tables."""

import datetime
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from grainfield import catalog  # noqa: E402
from grainfield.plans.views import TABLES  # noqa: E402


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    found = catalog.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    asked = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in asked.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in asked.fetchall())
