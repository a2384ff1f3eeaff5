"""Registered queries and their SQL on keys and groups as large tables have them."""

import duckdb
import pandas as pd
import pytest

from quillstone.plans import catalog

SF = "/root/testdata/sf0.001"


def same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    cols = sorted(got.columns)
    tidy = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    assert len(got) == len(want) and len(got)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, rtol=0, atol=1e-6)


@pytest.fixture(scope="module")
def long_numbers(tmp_path_factory):
    """The smallest orders three times, once with numbers of six digits and twice with seven, so that images share paths."""
    sf = tmp_path_factory.mktemp("numbers")
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        each = " UNION ALL ".join(f"SELECT * REPLACE ({n} AS {key}) FROM '{SF}/{t}.parquet'" for n in (f"{key} + 100000", f"({key} + 100000) * 10", f"({key} + 100000) * 10 + 4"))
        duckdb.execute(f"COPY ({each}) TO '{sf}/{t}.parquet'")
    return str(sf)


@pytest.mark.parametrize("name", [
    "j02_latest_by_basename",
    "j03_absent",
    "j05_common_images",
    "j07_remaining",
])
def test_images_that_share_a_path(spark, long_numbers, name):
    same_rows(spark, long_numbers, name)


def test_an_image_of_many_boxes(spark, tmp_path):
    """17 boxes on both sides: one more than SQL once had steps for."""
    duckdb.execute(f"COPY (FROM '{SF}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    lines = "SELECT l.* REPLACE (11 AS l_orderkey, 1 + i % 6 AS l_linenumber, 7 * i AS l_partkey, 3 * i + 1 AS l_suppkey) FROM range(17) r(i), (FROM '{0}/lineitem.parquet' LIMIT 1) l UNION ALL (FROM '{0}/lineitem.parquet' WHERE l_orderkey < 30 AND l_orderkey <> 11)"
    duckdb.execute(f"COPY ({lines.format(SF)}) TO '{tmp_path}/lineitem.parquet'")
    same_rows(spark, str(tmp_path), "k05_optimal_costs")
