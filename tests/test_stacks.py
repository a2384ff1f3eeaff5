"""Areas and matches of many images at once against plain loops, on odd boxes, and the queries that rest on them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import stacks
from quillstone.operators import assignment, matching, metrics, regions
from quillstone.plans import reports

BOX = "idx long, x0 double, y0 double, x1 double, y1 double, label string"


def _some(rng, n):
    corner = lambda: rng.choice([None, 0.0, 10.0, 20.0, 50.0])
    return [(i // 2 if n == 5 else i, *(corner() if rng.random() < 0.1 else float(v) for v in _corners(rng)), rng.choice(["both", "artifact", "misalignment", "odd", None])) for i in range(n)]


def _corners(rng):
    if rng.random() < 0.1:
        return 0, 0, 0, 0
    x, y = rng.randrange(0, 50, 5), rng.randrange(0, 50, 5)
    return x, y, x + rng.randrange(-5, 40, 5), y + rng.randrange(5, 40, 5)


@pytest.fixture(scope="module")
def images(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 17 == 0 else _some(rng, rng.randrange(7)), _some(rng, rng.randrange(7))) for i in range(400)]
    return spark.createDataFrame(rows, f"image_id long, gt array<struct<{BOX.replace(' ', ':').replace(',:', ',')}>>, pred array<struct<{BOX.replace(' ', ':').replace(',:', ',')}>>")


@pytest.mark.parametrize(("labels", "eps", "least"), [(True, None, 0.1), (False, None, 0.3), (False, 1e-9, 0.1)])
def test_greedy_places_are_those_of_the_ordered_pairs(images, monkeypatch, labels, eps, least):
    monkeypatch.setattr(stacks, "STACK", 50)
    side = lambda c: F.sort_array(F.coalesce(c, F.array()))
    both = images.select("image_id", side("gt").alias("gt"), side("pred").alias("pred"))
    plain = F.transform(matching.greedy(matching.pairs_of(F.col("gt"), F.col("pred"), least, labels, eps)), lambda m: F.struct(m["iou"], m["p"]["idx"], m["g"]["idx"]))
    at = lambda m: F.struct(m["iou"], F.get("pred", m["p"])["idx"], F.get("gt", m["g"])["idx"])
    got = both.select("image_id", plain.alias("want"), F.transform(stacks.greedy_places(F.col("gt"), F.col("pred"), least, labels, eps), at).alias("got")).collect()
    assert sum(len(r.want) for r in got) > 30
    assert [[tuple(m) for m in r.got] for r in got] == [[tuple(m) for m in r.want] for r in got]


def _area(a, b):
    """Shared and joint area by unit cells of the few edges."""
    real = lambda boxes: [x for x in boxes or () if any(x[1:5])]
    a, b = real(a), real(b)
    xs, ys = (sorted({x[k] for x in a + b for k in (d, d + 2) if x[k] is not None}) for d in (1, 2))
    on = lambda boxes, x, y: any(None not in r[1:5] and r[1] <= x < r[3] and r[2] <= y < r[4] for r in boxes)
    i = u = 0
    for (x, xz), (y, yz) in itertools.product(itertools.pairwise(xs), itertools.pairwise(ys)):
        g, p = on(a, x, y), on(b, x, y)
        i, u = i + (g and p) * (xz - x) * (yz - y), u + (g or p) * (xz - x) * (yz - y)
    return (1.0 if not a and not b else i / u if a and b and u > 0 else 0.0), not a and not b


def test_union_of_odd_boxes(images):
    rows = images.select("gt", "pred", regions.union_iou(F.col("gt"), F.col("pred")).alias("u")).collect()
    assert [(round(r.u.iou, 9), r.u.both_empty) for r in rows] == [(round(a, 9), b) for a, b in (_area(r.gt, r.pred) for r in rows)]


def test_largest_weights_by_cells(spark):
    rng = random.Random(5)
    rows = [(i, [(x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9), rng.randrange(-3, 9)) for x, y in ((rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(6)))]) for i in range(60)]
    got = spark.createDataFrame(rows, "i int, b array<struct<x0:int,y0:int,x1:int,y1:int,w:long>>").select("b", stacks.largest_weights(F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == [sum(max([0, *(w for a, b, c, d, w in r.b if a <= x < c and b <= y < d)]) for x in range(20) for y in range(20)) for r in got]


def test_pairs_that_are_alike_count_by_their_number(spark):
    once = spark.createDataFrame([("artifact", "artifact", 3), ("artifact", "misalignment", 2)], "gt_label string, pred_label string, n int")
    many = once.select("*", F.explode(F.sequence(F.lit(1), "n")))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(metrics.label_f1(once, weight="n")) == key(metrics.label_f1(many))


def test_each_two_descriptions_are_compared_once(spark):
    alike = spark.createDataFrame([("artifact", p, 1, 2, n) for p, n in (("artifact", 5), ("both", 7))], "gt_label string, pred_label string, gt_importance int, pred_importance int, n long")
    assert [(r.gt_label, r.n) for r in reports._cosines(spark, "/root/testdata/sf0.001", alike).collect()] == [("artifact", 12)]


def test_rewards_of_matches_that_hold_importance(spark):
    shape = "image_id long, gt_idx long, importance int"
    gt, pred = spark.createDataFrame([(1, 0, 30), (1, 1, None)], shape), spark.createDataFrame([(1, 0, 50), (1, 1, 60)], shape.replace("gt", "pred"))
    m = spark.createDataFrame([(1, 0, 1, 0.5, 30, 60), (1, 1, 0, 0.25, None, 50)], "image_id long, gt_idx long, pred_idx long, diou double, gt_importance int, pred_importance int")
    held = assignment.rewards(gt, pred, m)
    assert held.collect() == assignment.rewards(gt, pred, m.drop("gt_importance", "pred_importance")).collect()
