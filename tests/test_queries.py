"""Every catalogue query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from attriva.plans import queries as catalog
from attriva.plans import card_queries, function_queries, match_queries, rules, source_queries  # noqa: F401

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "is_finite"):
        return round(float(v), 9)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        assert got or name in ("q_donor_pick",)
        return
    res = con.execute(catalog.SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in res.fetchall()), key=repr)
