"""Every core query against its SQL on the small tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from siltstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value if value is None or isinstance(value, (bool, int)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    if name not in registry.ORACLES:
        assert all(len(r) == len(df.columns) for r in rows)
        return
    found = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: repr(row)
    expected = sorted((tuple(plain(v) for _, v in sorted(zip(columns, row))) for row in found.fetchall()), key=key)
    assert sorted((tuple(plain(row[c]) for c in sorted(columns)) for row in rows), key=key) == expected


def test_every_table_is_read_by_name(sf):
    assert all(Path(sf, f"{t}.parquet").exists() for t in TABLES)
