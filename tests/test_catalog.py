"""Every query that has SQL against DuckDB over whole small tables; the others give rows."""

import glob
import os

import duckdb
import pytest

from nearfield.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: None if v is None or v != v else str(v) if hasattr(v, "isoformat") else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    expected = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(rows, found.columns) == plain(expected.fetchall(), expected.columns)
