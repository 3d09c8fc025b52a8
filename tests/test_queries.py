import glob
import os

import duckdb
import pytest

from rasterloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", queries.ORACLES)
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_quantize_keeps_all_colours(spark):
    out = queries.quantize(spark, SF).collect()
    assert len({r.box for r in out}) == 64
    assert sum(r["count"] for r in out) == spark.read.parquet(f"{SF}/part.parquet").count()
