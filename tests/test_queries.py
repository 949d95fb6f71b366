"""Every core query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone import plans as bindings


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = bindings.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in bindings.SQL:
        assert rows
        return
    found = tables.execute(bindings.SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    key = lambda r: tuple(repr(x) for x in r)
    assert sorted((tuple(map(plain, r)) for r in rows), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=key)
