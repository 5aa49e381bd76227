"""Queries against their SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from chronopanel.plans import catalog


def rows(frame):
    """Rows as text, in order, without regard to how engines hold nulls."""
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    plain = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


def tables(sf):
    db = duckdb.connect()
    for p in os.listdir(sf):
        db.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{p}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = tables(sf).execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
