"""Matching of predicted and true boxes within images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import stacks
from quillstone.functions.geometry import box, compatible, iou


def candidate_pairs(gt: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """Pairs of an image with IoU of least or more: one shuffle by image, the rest is a filter on the joined rows."""
    side = lambda df, p: df.select("image_id", *[F.col(c).alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1", "label", "importance")], f"{p if p == 'gt' else 'pred'}_idx")
    pairs = side(gt, "gt").join(side(pred, "pred"), "image_id")
    return pairs.withColumn("iou", iou(box("gt_"), box("pred_"))).where(F.col("iou") >= least)


def greedy_matches(pairs: DataFrame, keys: list[str], labels: bool = True) -> DataFrame:
    """Greedy one-to-one matches per keys, best first by (iou, pred_idx, gt_idx), all descending.

    A pair whose labels do not fit takes no box, so such pairs can go first. The pairs of one image are few.
    """
    usable = pairs.where(compatible(F.col("gt_label"), F.col("pred_label"))) if labels else pairs
    ordered = usable.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("iou", "pred_idx", "gt_idx")), asc=False).alias("pairs"))
    taken = F.aggregate(
        "pairs",
        F.array().cast("array<struct<iou:double,pred_idx:bigint,gt_idx:bigint>>"),
        lambda got, p: F.when(F.exists(got, lambda g: (g["pred_idx"] == p["pred_idx"]) | (g["gt_idx"] == p["gt_idx"])), got).otherwise(
            F.concat(got, F.array(F.struct(p["iou"], p["pred_idx"].cast("long").alias("pred_idx"), p["gt_idx"].cast("long").alias("gt_idx"))))
        ),
    )
    return ordered.select(*keys, F.explode(taken).alias("m")).select(*keys, "m.iou", "m.pred_idx", "m.gt_idx")


def image_sides(gt: DataFrame, pred: DataFrame, *extra: str) -> DataFrame:
    """(image_id, gt, pred): the boxes of both sides as arrays of structs (idx, x0, y0, x1, y1, label, extra), one shuffle by image.

    An image that only one side has is there with an empty array for the other. The boxes of one image are few.
    """
    corners = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    side = lambda df, idx, k: df.select("image_id", F.lit(k).alias("side"), F.struct(F.col(idx).cast("long").alias("idx"), *corners, F.col("label").cast("string").alias("label"), *[F.col(c).cast("double").alias(c) for c in extra]).alias("box"))
    both = side(gt, "gt_idx", 0).unionByName(side(pred, "pred_idx", 1))
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("box"))))
    return both.groupBy("image_id").agg(of(0).alias("gt"), of(1).alias("pred"))


def pairs_of(gt: Column, pred: Column, least: float, labels: bool = True, eps: float | None = None) -> Column:
    """array<struct(iou, p, g)>, best first by (iou, index of pred, index of gt), of the boxes of two arrays that may match."""
    corners = lambda b: {c: b[c] for c in ("x0", "y0", "x1", "y1")}
    fits = lambda g, p: compatible(g["label"], p["label"]) if labels else F.lit(True)
    each = F.flatten(F.transform(gt, lambda g: F.transform(pred, lambda p: F.struct(F.when(F.coalesce(fits(g, p), F.lit(False)), iou(corners(g), corners(p), eps)).alias("iou"), p.alias("p"), g.alias("g")))))
    return F.sort_array(F.filter(each, lambda x: x["iou"] >= least), asc=False)


def greedy(pairs: Column) -> Column:
    """The pairs, taken in their order, whose boxes are both still free."""
    taken = lambda got, x: F.exists(got, lambda y: (y["p"]["idx"] == x["p"]["idx"]) | (y["g"]["idx"] == x["g"]["idx"]))
    return F.aggregate(pairs, F.filter(pairs, lambda x: F.lit(False)), lambda got, x: F.when(taken(got, x), got).otherwise(F.concat(got, F.array(x))))


def matched_boxes(gt: DataFrame, pred: DataFrame, least: float, *extra: str, labels: bool = True, eps: float | None = None) -> DataFrame:
    """(image_id, iou, p, g): greedy matches with both boxes as structs; eps is that of geometry.iou."""
    sides = image_sides(gt, pred, *extra).withColumn("m", stacks.greedy_places(F.col("gt"), F.col("pred"), least, labels, eps))
    both = F.transform("m", lambda m: F.struct(m["iou"].alias("iou"), F.get("pred", m["p"]).alias("p"), F.get("gt", m["g"]).alias("g")))
    return sides.select("image_id", F.explode(both).alias("m")).select("image_id", "m.iou", "m.p", "m.g")


def image_outcomes(gt: DataFrame, pred: DataFrame, least: float, labels: bool = True) -> DataFrame:
    """(image_id, outcome, label): tp and fn by the true label, fp by the predicted one; matches never leave their image's row."""
    sides = image_sides(gt, pred).withColumn("m", stacks.greedy_places(F.col("gt"), F.col("pred"), least, labels))
    told = lambda side, k, hit, miss: F.transform(side, lambda b, i: F.struct(F.when(F.array_contains(F.col("m")[k], i), F.lit(hit)).otherwise(F.lit(miss)).alias("outcome"), b["label"].alias("label")))
    both = F.concat(told("gt", "g", "tp", "fn"), F.filter(told("pred", "p", None, "fp"), lambda o: o["outcome"].isNotNull()))
    return sides.select("image_id", F.explode(both).alias("o")).select("image_id", "o.outcome", "o.label")


def swept(gt: DataFrame, pred: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, tp, fp, fn) at every threshold, from one pass over the images; thresholds without a match have rows too."""
    at = F.explode(F.transform(F.array(*map(F.lit, thresholds)), lambda t: F.struct(t.alias("threshold"), F.size(greedy(F.filter("pairs", lambda x: x["iou"] >= t))).alias("n"))))
    sides = image_sides(gt, pred)
    per = sides.withColumn("pairs", pairs_of(F.col("gt"), F.col("pred"), min(thresholds))).select(F.size("gt").alias("n_gt"), F.size("pred").alias("n_pred"), at.alias("t"))
    n = per.groupBy("t.threshold").agg(F.sum("t.n").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gt").alias("n_gt"))
    return n.select("threshold", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))
