"""Every registered query that has SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

from cardloom.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def compare(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    at = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert len(rows) == len(expected)
    bad = [(a, b) for a, b in zip(rows, expected, strict=True) if a != b]
    assert not bad, f"{len(bad)} of {len(rows)} differ in {columns}: {bad[:3]}"
    return len(rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, sf, name):
    assert compare(spark, duck, sf, name) > 0
