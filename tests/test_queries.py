import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from orthoweave.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(v):
    return None if v is None or v != v else float(f"{float(v):.9g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    if name not in registry.ORACLES:
        assert got
        return
    rel = con.sql(registry.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
