"""Every query against its SQL twin, as multisets of rows."""

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import seedloom.showcase_sets  # noqa: F401
from seedloom.showcase import ORACLES, QUERIES

FOLDER = os.environ.get("SHOWCASE_SF_DIR", "/root/testdata/sf0.001")
TABLES = [p.stem for p in sorted(Path(FOLDER).glob("*.parquet"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = multiset(df.columns, [tuple(r) for r in df.collect()])
    assert sum(got.values()) > 0 or name in ("agent_pairs",)
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        expected = multiset(columns, found.fetchall())
        assert list((got - expected).items())[:3] == list((expected - got).items())[:3] == []
