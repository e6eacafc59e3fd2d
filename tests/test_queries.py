"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillstone.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.8g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    names, rows = rows_of(catalog.QUERIES[name](spark, SF).toArrow())
    assert names
    if name in catalog.ORACLE_SQL:
        assert (names, rows) == rows_of(duck.sql(catalog.ORACLE_SQL[name]).to_arrow_table())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
