"""Optimal assignment of predicted to true boxes per image, and the rewards on it.

Boxes are gathered per image by Spark (an image has few); only the assignment itself is Python, on Arrow batches of images,
in which images with equally many boxes on each side are assigned together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISMATCH, ACCEPTED = 2.0, 1.5
#: Pairs of boxes of images that are worked on together.
STACK = 1 << 20


def least_costs(cost: np.ndarray) -> np.ndarray:
    """For each matrix of a stack of one shape, with no more rows than columns, the column of each row at least total cost.

    Shortest augmenting paths with potentials; the matrices of a stack advance together, each to its own end.
    """
    size, n, m = cost.shape
    row_price, column_price, owner = np.zeros((size, n + 1)), np.zeros((size, m + 1)), np.full((size, m + 1), n)
    for i in range(n):
        owner[:, m] = i
        at, slack, back, done = np.full(size, m), np.full((size, m), np.inf), np.full((size, m), m), np.zeros((size, m + 1), bool)
        on = np.arange(size)  # those whose path has not reached a free column
        while len(on):
            here = at[on]
            done[on, here] = True
            row, shut = owner[on, here], done[on]
            through = cost[on, row] - row_price[on, row][:, None] - column_price[on, :m]
            better = ~shut[:, :m] & (through < slack[on])
            now = np.where(better, through, slack[on])
            back[on] = np.where(better, here[:, None], back[on])
            nearest = np.where(shut[:, :m], np.inf, now).argmin(1)
            step = now[np.arange(len(on)), nearest]
            which, column = np.nonzero(shut)
            row_price[on[which], owner[on[which], column]] += step[which]
            column_price[on] -= np.where(shut, step[:, None], 0)
            slack[on] = now - np.where(shut[:, :m], 0, step[:, None])
            at[on] = nearest
            on = on[owner[on, nearest] != n]
        on = np.arange(size)
        while len(on):
            before = back[on, at[on]]
            owner[on, at[on]] = owner[on, before]
            at[on] = before
            on = on[before != m]
    out = np.empty((size, n), int)
    which, column = np.nonzero(owner[:, :m] != n)
    out[which, owner[which, column]] = column
    return out


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, as many as the shorter side."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in least_cost(cost.T))
    return [(i, int(j)) for i, j in enumerate(least_costs(cost[None])[0])]


def _diou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """DIoU of every box of a with every box of b, 0 terms where a divisor is 0; leading axes are those of stacks."""
    a, b = a[..., :, None, :], b[..., None, :, :]
    side = (np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2])).clip(0)
    both = side.prod(-1)
    union = (a[..., 2:] - a[..., :2]).prod(-1) + (b[..., 2:] - b[..., :2]).prod(-1) - both
    centre = (((a[..., :2] + a[..., 2:] - b[..., :2] - b[..., 2:]) / 2) ** 2).sum(-1)
    diagonal = ((np.maximum(a[..., 2:], b[..., 2:]) - np.minimum(a[..., :2], b[..., :2])) ** 2).sum(-1)
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0) - np.where(diagonal > 0, centre / np.where(diagonal > 0, diagonal, 1), 0)


def _flat(side: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Sizes and starts of lists of boxes, and the index, corners and labels of all their boxes."""
    size = side.value_lengths().to_numpy()
    boxes = dict(zip((f.name for f in side.type.value_type), side.flatten().flatten(), strict=True))
    corners = np.stack([boxes[s].to_numpy(zero_copy_only=False) for s in ("x0", "y0", "x1", "y1")], -1)
    return size, np.cumsum(size) - size, boxes["idx"].to_numpy(), corners, pc.fill_null(boxes["label"], "")


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        (n, n_at, gt_idx, gt, one), (m, m_at, pred_idx, pred, two) = _flat(b.column(1)), _flat(b.column(2))
        labels = pa.concat_arrays([pa.array(["both"], one.type), one, two]).dictionary_encode().indices.to_numpy()
        one, two, found = labels[1 : 1 + len(gt)], labels[1 + len(gt) :], []
        order = np.lexsort((m, n))  # images of one shape stand together
        starts = np.flatnonzero(np.r_[True, np.diff(n[order]) | np.diff(m[order])]) if len(order) else []
        for like in np.split(order, starts[1:]):
            rows, columns = int(n[like[0]]), int(m[like[0]])
            for k in range(0, len(like), most := max(1, STACK // (rows * columns))):
                images = like[k : k + most]
                g, p = n_at[images][:, None] + np.arange(rows), m_at[images][:, None] + np.arange(columns)
                left, right = one[g][:, :, None], two[p][:, None]
                near = _diou(gt[g], pred[p])
                cost = np.where((left == right) | (left == 0) | (right == 0), -near, MISMATCH)  # the first label is ``both``
                if rows > columns:
                    j = np.tile(np.arange(columns), (len(images), 1))
                    i = least_costs(cost.transpose(0, 2, 1))
                else:
                    i = np.tile(np.arange(rows), (len(images), 1))
                    j = least_costs(cost)
                at = np.arange(len(images))[:, None]
                of, place = np.nonzero(cost[at, i, j] < ACCEPTED)
                i, j = i[of, place], j[of, place]
                found.append((images[of], gt_idx[g[of, i]], pred_idx[p[of, j]], near[of, i, j]))
        if found:
            of, *columns = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), *map(pa.array, columns)], ["image_id", "gt_idx", "pred_idx", "diou"])


def optimal_matches(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(image_id, gt_idx, pred_idx, diou): the assignment of largest total DIoU within each image.

    Labels must be equal but for case, or one of them ``both``. Images without boxes on a side have no rows.
    """
    side = lambda df, idx: F.sort_array(F.collect_list(F.struct(F.col(idx).cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.lower("label").alias("label"))))
    a = gt.groupBy("image_id").agg(side(gt, "gt_idx").alias("gt"))
    b = pred.groupBy("image_id").agg(side(pred, "pred_idx").alias("pred"))
    return a.join(b, "image_id").select("image_id", "gt", "pred").mapInArrow(_assign, "image_id long, gt_idx long, pred_idx long, diou double")


def gated(rewards: DataFrame, passed: DataFrame) -> DataFrame:
    """rewards with total -1 for the images (image_id, passed) whose reply has not passed the format gate, or has none; with the column passed."""
    out = rewards.join(passed.select("image_id", "passed").hint("merge"), "image_id", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    return out.withColumn("total", F.when(F.col("passed"), F.col("total")).otherwise(F.lit(-1.0)))


def telemetry(rewards: DataFrame, *keys: str) -> DataFrame:
    """For each value of keys and each of the four cases of boxes on both sides, on one or on none: n, failures (a total of -1), matched and unmatched boxes of both sides, means of the terms."""
    case = F.concat(F.when(F.col("n_gt") > 0, "gt").otherwise("no_gt"), F.lit("_"), F.when(F.col("n_pred") > 0, "pred").otherwise("no_pred")).alias("case")
    mean = [F.round(F.avg(c), 5).alias(c) for c in ("box", "description", "importance", "total")]
    left = lambda c, name: F.sum(F.col(c) - F.col("n_matched")).alias(name)
    return rewards.groupBy(*keys, case).agg(F.count("*").alias("n"), F.count_if(F.col("total") == -1).alias("failures"), F.sum("n_matched").alias("matched"), left("n_gt", "unmatched_gt"), left("n_pred", "unmatched_pred"), *mean)


def rewards(gt: DataFrame, pred: DataFrame, matches: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(image_id, n_gt, n_pred, n_matched, box, description, importance, total) for every image of images, or with a box on either side.

    box: 0.3 without boxes on both sides, -0.8 with true boxes only, -0.3 with predicted ones only, else the total DIoU less half a point for
    every unmatched box, over the larger count, within -1..1. importance: closeness within 50, a true one
    of null counting as 50. total: 0.6 box + 0.25 description + 0.15 importance, where matches has a
    column ``similarity`` for the descriptions (without it that term is 0). Where matches has gt_importance and
    pred_importance, the boxes of a pair are not looked up.
    """
    clip = lambda c, low: F.greatest(F.least(c, F.lit(1.0)), F.lit(low))
    held = matches if "similarity" in matches.columns else matches.withColumn("similarity", F.lit(0.0))
    if {"gt_importance", "pred_importance"} <= set(held.columns):
        pairs = held.withColumns({"g": F.coalesce("gt_importance", F.lit(50)), "p": F.col("pred_importance")})
    else:
        pairs = held.join(gt.select("image_id", "gt_idx", F.coalesce("importance", F.lit(50)).alias("g")).hint("merge"), ["image_id", "gt_idx"]).join(pred.select("image_id", "pred_idx", F.col("importance").alias("p")).hint("merge"), ["image_id", "pred_idx"])
    close = F.coalesce(clip(1 - F.abs(F.col("g") - F.col("p")) / 50.0, 0.0), F.lit(0.0))
    m = pairs.groupBy("image_id").agg(F.count("*").alias("n_matched"), F.sum("diou").alias("near"), F.sum(close).alias("close"), F.sum(clip((F.col("similarity") - 0.5) / 0.4, 0.0)).alias("like"))
    sizes = gt.groupBy("image_id").agg(F.count("*").alias("n_gt")).join(pred.groupBy("image_id").agg(F.count("*").alias("n_pred")), "image_id", "full_outer")
    if images is not None:
        sizes = images.select("image_id").join(sizes, "image_id", "left")
    t = sizes.join(m.hint("merge"), "image_id", "left").na.fill(0)
    most = F.greatest("n_gt", "n_pred", F.lit(1))
    missed = F.col("n_gt") + F.col("n_pred") - 2 * F.col("n_matched")
    box = F.when((F.col("n_gt") == 0) & (F.col("n_pred") == 0), 0.3).when(F.col("n_pred") == 0, -0.8).when(F.col("n_gt") == 0, -0.3).otherwise(clip((F.col("near") - 0.5 * missed) / most, -1.0))
    t = t.withColumn("box", box).withColumn("importance", F.col("close") / most).withColumn("description", F.col("like") / most)
    total = 0.6 * F.col("box") + 0.25 * F.col("description") + 0.15 * F.col("importance")
    return t.select("image_id", "n_gt", "n_pred", "n_matched", "box", "description", "importance", total.alias("total"))
