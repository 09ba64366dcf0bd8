"""Every catalogued query against its SQL."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

from strataline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    own = duckdb.connect()
    for name in os.listdir(SF):
        own.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return own


def flat(value):
    return round(value, 9) if isinstance(value, float) else str(value) if isinstance(value, datetime.date) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted([tuple(flat(r[c]) for c in columns) for r in frame.collect()], key=repr)
    found = sql.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted([tuple(flat(r[names.index(c)]) for c in columns) for r in found.fetchall()], key=repr)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
