"""Cells whose centres lie on an edge of a box or a tube, as they do where all headings are 0, fall as in SQL."""

import shutil

import duckdb
import pytest

import __spark_entry__ as entry

#: Orders of customers at sf0.01 that have such cells once order keys are 46 modulo 63, which gives every track heading 0.
CUSTOMERS = (397, 451, 457, 520, 529, 581, 815, 1024, 1418, 1490)


@pytest.fixture(scope="module")
def straight(tmp_path_factory):
    folder = tmp_path_factory.mktemp("straight")
    source = "/root/testdata/sf0.01"
    shutil.copy(f"{source}/customer.parquet", folder)
    duckdb.connect().execute(f"""copy (select * from (select (46 + 63 * (row_number() over () - 1))::bigint as o_orderkey, * exclude (o_orderkey) from '{source}/orders.parquet')
        where o_custkey in {CUSTOMERS}) to '{folder}/orders.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", ["OC1_OC2_rasterize_boxes", "OC3_rasterize_cv", "OC4_rasterize_tubes"])
def test_as_in_sql(spark, straight, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{straight}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, straight).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
