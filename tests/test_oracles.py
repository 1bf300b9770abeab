"""Every query that has SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

from quarry.plans import all_queries
from quarry.sources.tables import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None:
        return "\0null"
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        x = float(x)
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(all_queries.ORACLES))
def test_same_rows(spark, duck, name):
    got = all_queries.QUERIES[name](spark, SF)
    want = duck.execute(all_queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    have, expected = rows(got.columns, got.collect()), rows(columns, want.fetchall())
    assert len(have) == len(expected)
    assert have == expected


def test_names():
    assert set(all_queries.ORACLES) <= set(all_queries.QUERIES)
