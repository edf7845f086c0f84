"""The queries of the readers and of the report's pairs of levels, against their SQL over the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from terrajobs.jobs import files, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
ALSO = ("geodesic_distance", "simplify_polygon")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", [*files.QUERIES, *ALSO])
def test_query_equals_its_sql(spark, tables, name):
    known = queries.QUERIES | files.QUERIES
    found = known[name](spark, FOLDER)
    columns = sorted(found.columns)
    wanted = tables.sql((queries.SQL | files.SQL)[name])
    assert sorted(wanted.columns) == columns
    key = lambda rows: sorted(map(repr, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)))
    assert key(tuple(r) for r in found.select(*columns).collect()) == key(wanted.select(*(f'"{c}"' for c in columns)).fetchall())
