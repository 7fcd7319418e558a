"""Every query with an oracle gives the oracle's rows, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from boleflow.plans.oracles import ORACLES
from boleflow.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLES[name])
    columns = sorted(c[0] for c in cur.description)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in cur.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=repr)
    assert have == want


def test_rows_only(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0, name  # the mask of sf0.001 has no stem
