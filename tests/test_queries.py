"""Every reference query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from phonolake.plans import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def canon(rows, columns):
    def cell(x):
        return "" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows, columns = [r.asDict() for r in df.collect()], sorted(df.columns)
    if name in queries.SQL:
        found = con.sql(queries.SQL[name])
        assert sorted(found.columns) == columns
        assert canon([dict(zip(found.columns, r, strict=True)) for r in found.fetchall()], columns) == canon(rows, columns)
    else:
        assert rows
