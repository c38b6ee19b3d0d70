"""Every registered query of the engine against its SQL, at the smallest scale."""

import os

import pytest

from framewright import Series, catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    return None if v is None else str(v) if isinstance(v, bool) else round(float(v), 6) if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def tables():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    got = catalog.QUERIES[name](spark, D)
    want = tables.sql(catalog.ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = want.fetchall()
    assert sorted(repr([plain(r[k]) for k in cols]) for r in got.collect()) == sorted(repr([plain(r[want.columns.index(k)]) for k in cols]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
def test_length_is_one_job(spark, monkeypatch):
    """A series' length is a job of Spark's: series_basics asks once, not once a row."""
    asked, count = [], Series.__len__
    monkeypatch.setattr(Series, "__len__", lambda self: asked.append(1) or count(self))
    rows = catalog.QUERIES["series_basics"](spark, D).collect()
    assert len(asked) == 1 and {r["n"] for r in rows} == {len(rows)}
