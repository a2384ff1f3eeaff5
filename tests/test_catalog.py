"""Registered queries against their SQL on the smallest tables, and hand-made cases."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.functions import geometry, paths, text
from quillstone.operators import advantage, matching, rows, spatial
from quillstone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    tidy = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, rtol=0, atol=1e-6)


PAIRS = "image_id long, iou double, pred_idx long, gt_idx long, pred_label string, gt_label string"


def matches(spark, data, **kw):
    df = spark.createDataFrame([(1, *r) for r in data], PAIRS)
    return sorted((r.pred_idx, r.gt_idx) for r in matching.greedy_matches(df, ["image_id"], **kw).collect())


def test_greedy_ties_go_to_the_higher_index(spark):
    a = "artifact"
    assert matches(spark, [(0.9, 0, 0, a, a), (0.9, 1, 0, a, a), (0.8, 0, 1, a, a)]) == [(0, 1), (1, 0)]


def test_incompatible_best_pair_takes_no_box(spark):
    assert matches(spark, [(0.9, 0, 0, "artifact", "misalignment"), (0.6, 0, 1, "artifact", "artifact")]) == [(0, 1)]
    assert matches(spark, [(0.9, 0, 0, "artifact", "misalignment"), (0.6, 0, 1, "artifact", "artifact")], labels=False) == [(0, 0)]


def test_label_both(spark):
    df = spark.createDataFrame([("both", "artifact", True), ("both", "both", True), ("both", "odd", False), ("artifact", "misalignment", False)], "a string, b string, fits boolean")
    assert df.where(geometry.compatible(F.col("a"), F.col("b")) != F.col("fits")).count() == 0


def test_group_of_one(spark):
    df = spark.createDataFrame([(1, 1, 5.0)], "sample_id long, unique_id long, scalar double")
    assert advantage.group_advantage(df).first().advantage == 0 and advantage.group_deviation(df).first().deviation == 0


def test_overlap_of_one_label_takes_the_largest_weight(spark):
    df = spark.createDataFrame([(1, "artifact", 0, 0, 500, 500, 40), (1, "artifact", 0, 0, 500, 500, 80), (1, "misalignment", 0, 0, 250, 250, 100), (2, "artifact", 9, 9, 9, 9, 5)], "image_id long, label string, x0 int, y0 int, x1 int, y1 int, importance int")
    got = {(r.y, r.x): r.penalty for r in spatial.penalty_map(df, {"misalignment": 0.5}, 0.1, grid=2).collect()}
    assert got == {(0, 0): pytest.approx(0.08)}


def test_strip_think_needs_the_line_end(spark):
    df = spark.createDataFrame([("<think>x</think>\nrest", "rest"), ("<think>x</think>rest", "<think>x</think>rest")], "t string, want string")
    assert df.where(text.strip_think(F.col("t")) != F.col("want")).count() == 0


def test_prompt_id_and_grid(spark):
    df = spark.createDataFrame([("two cats watering roses", "a 2 x 3 grid", "none")], "p string, g string, n string")
    r = df.select(text.prompt_id(F.col("p")).alias("id"), text.grid_size(F.col("g")).alias("g"), text.grid_size(F.col("n")).alias("n")).first()
    assert r.id == -8882876797671165504 and tuple(r.g) == (2, 3) and tuple(r.n) == (1, 1)


def test_global_index_over_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("k")).repartition(7)
    got = rows.global_index(df, F.col("k")).collect()
    assert all(r["index"] == r["k"] for r in got) and len(got) == 1000


def test_paths(spark):
    df = spark.createDataFrame([("/d/SDG/sana/test/a.b.png", "sana", "test"), ("/d/SDG/dataset/x.png", "", "neither"), ("", "", "missing"), (None, None, "missing")], "p string, g string, s string")
    assert df.where(~paths.generator_name(F.col("p")).eqNullSafe(F.col("g")) | (paths.exclusive_split(F.col("p")) != F.col("s"))).count() == 0
