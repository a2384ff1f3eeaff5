"""Areas and greedy matches of the boxes of images as Column functions on Arrow batches, with the boxes of many images as arrays.

Spark gathers the boxes per image, which are few; here only the arithmetic on them is worked off, many images together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")
#: Pairs of boxes, or cells of images, that are worked on together.
STACK = 1 << 20


def fields(side: pa.ListArray) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """Sizes and starts of lists of structs (null: empty), and the fields of all their structs."""
    size = pc.fill_null(side.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(int)
    inner = side.flatten()
    return size, np.cumsum(size) - size, dict(zip((f.name for f in inner.type), inner.flatten(), strict=True))


def _numbers(boxes: dict[str, pa.Array], *names: str) -> np.ndarray:
    """The fields as one array of doubles, null as NaN."""
    return np.stack([boxes[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names], -1)


def _blocks(weight: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose weights sum to about STACK; a heavier row stands alone."""
    at, total = 0, np.cumsum(weight)
    while at < len(weight):
        end = max(at + 1, int(np.searchsorted(total, STACK + (total[at - 1] if at else 0), "right")))
        yield at, end
        at = end


def _alike(weight: int, *sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows whose lists have the same sizes, in stacks."""
    if len(sizes[0]):
        order = np.lexsort(sizes)
        for like in np.split(order, np.flatnonzero(np.any([np.diff(s[order]) for s in sizes], 0)) + 1):
            cells = weight * max(1, sum(int(s[like[0]]) for s in sizes)) ** 3
            for k in range(0, len(like), most := max(1, STACK // cells)):
                yield like[k : k + most]


# matching -------------------------------------------------------------------------------------------------------


def _iou(a: np.ndarray, b: np.ndarray, eps: float | None) -> np.ndarray:
    """geometry.iou of boxes in rows; null corners, which are NaN, as there."""
    w = np.fmin(a[:, 2], b[:, 2]) - np.fmax(a[:, 0], b[:, 0])
    h = np.fmin(a[:, 3], b[:, 3]) - np.fmax(a[:, 1], b[:, 1])
    both = np.fmax(w, 0) * np.fmax(h, 0)
    if eps is not None:
        side = lambda c: np.fmax(c[:, 2] - c[:, 0], 0) * np.fmax(c[:, 3] - c[:, 1], 0)
        return both / (side(a) + side(b) - both + eps)
    area = lambda c: (c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1])
    union = area(a) + area(b) - both
    real = union > 0
    return np.where(real, both / np.where(real, union, 1), 0)


def _names(size: np.ndarray, start: np.ndarray, idx: pa.Array) -> np.ndarray:
    """A number for each box, the same for those of a list with the same index, which stand together."""
    if not len(idx):
        return np.zeros(0, int)
    value, null = pc.fill_null(idx, 0).to_numpy(zero_copy_only=False), idx.is_null().to_numpy(zero_copy_only=False)
    new = np.r_[True, (np.diff(value) != 0) | null[1:] | null[:-1]]
    new[start[size > 0]] = True
    return np.cumsum(new)


def _greedy(gt: pa.ListArray, pred: pa.ListArray, least: float, labels: bool, eps: float | None) -> pa.ListArray:
    (n, n_at, one), (m, m_at, two) = fields(gt), fields(pred)
    a, b, g_name, p_name = _numbers(one, *SIDES), _numbers(two, *SIDES), _names(n, n_at, one["idx"]), _names(m, m_at, two["idx"])
    known = pa.array(["both", "artifact", "misalignment"])
    code = pc.fill_null(pa.concat_arrays([known, one["label"].cast(pa.string()), two["label"].cast(pa.string())]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)[3:]
    g_label, p_label = code[: len(a)], code[len(a) :]
    counts, found = np.zeros(len(n), int), []
    for lo, hi in _blocks(n * m):
        pairs = n[lo:hi] * m[lo:hi]
        image = np.repeat(np.arange(lo, hi), pairs)
        k = np.arange(len(image)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        wide = m[image]
        g, p = n_at[image] + k // wide, m_at[image] + k % wide
        if labels:
            x, y = g_label[g], p_label[p]
            fit = (x >= 0) & ((x == y) | ((x == 0) & ((y == 1) | (y == 2))) | ((y == 0) & ((x == 1) | (x == 2))))
            image, g, p = image[fit], g[fit], p[fit]
        iou = _iou(a[g], b[p], eps)
        near = iou >= least
        image, g, p, iou = image[near], g[near], p[near], iou[near]
        order = np.lexsort((-g, -p, -iou, image))  # best first by iou, place of pred, place of gt
        held_g, held_p, kept = set(), set(), []
        for at, x, y in zip(order.tolist(), g_name[g[order]].tolist(), p_name[p[order]].tolist(), strict=True):
            if x not in held_g and y not in held_p:
                held_g.add(x)
                held_p.add(y)
                kept.append(at)
        kept = np.array(kept, int)
        counts += np.bincount(image[kept], minlength=len(n))
        found.append((iou[kept], p[kept] - m_at[image[kept]], g[kept] - n_at[image[kept]]))
    iou, p, g = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
    values = pa.StructArray.from_arrays([pa.array(iou, pa.float64()), pa.array(p, pa.int32()), pa.array(g, pa.int32())], ["iou", "p", "g"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values)


def greedy_places(gt: Column, pred: Column, least: float, labels: bool = True, eps: float | None = None) -> Column:
    """array<struct(iou, p, g)>: greedy one-to-one matches of two arrays of boxes (idx, corners, label) in order of idx, p and g their places from 0.

    Best first by (iou, idx of pred, idx of gt), all descending, of pairs with an IoU of least or more whose labels may match (geometry.compatible).
    """

    def run(one: pa.Array, two: pa.Array) -> pa.Array:
        return _greedy(one, two, least, labels, eps)

    return F.arrow_udf(run, "array<struct<iou:double,p:int,g:int>>")(gt, pred)


# areas ----------------------------------------------------------------------------------------------------------


def _inside(box: np.ndarray, low: int, high: int, edges: np.ndarray) -> np.ndarray:
    """(image, box, strip): whether the strip between two edges lies within the sides low to high of a box."""
    start = edges[:, None, :-1]
    return (box[:, :, low, None] <= start) & (start < box[:, :, high, None])


def _union(gt: pa.Array, pred: pa.Array) -> pa.Array:
    def real(side: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, _, boxes = fields(side)
        box = _numbers(boxes, *SIDES)
        # boxes of four zeros count as none, and so do those of zeros and nulls only
        kept = np.any((box != 0) & ~np.isnan(box), -1)
        size = np.bincount(np.repeat(np.arange(len(size)), size)[kept], minlength=len(size))
        return size, np.cumsum(size) - size, box[kept]

    (n, n_at, a), (m, m_at, b) = real(gt), real(pred)
    iou = np.zeros(len(n))
    none = (n == 0) & (m == 0)
    iou[none] = 1
    for like in _alike(8, n, m):
        rows, columns = int(n[like[0]]), int(m[like[0]])
        if not rows or not columns:
            continue
        box = np.concatenate([a[n_at[like][:, None] + np.arange(rows)], b[m_at[like][:, None] + np.arange(columns)]], 1)
        xs, ys = np.sort(box[:, :, ::2].reshape(len(like), -1), -1), np.sort(box[:, :, 1::2].reshape(len(like), -1), -1)
        on_x, on_y = _inside(box, 0, 2, xs).astype("f4"), _inside(box, 1, 3, ys).astype("f4")
        of = lambda s: np.matmul(on_y[:, s].transpose(0, 2, 1), on_x[:, s]) > 0
        g, p = of(slice(0, rows)), of(slice(rows, None))
        wide, high = np.nan_to_num(np.diff(xs)), np.nan_to_num(np.diff(ys))  # a strip beyond a null corner is in no box
        area = lambda c: np.matmul(high[:, None], np.matmul(c.astype(float), wide[:, :, None]))[:, 0, 0]
        both, every = area(g & p), area(g | p)
        iou[like] = np.where(every > 0, both / np.where(every > 0, every, 1), 0)
    return pa.StructArray.from_arrays([pa.array(iou), pa.array(none)], ["iou", "both_empty"])


def union_of_boxes(gt: Column, pred: Column) -> Column:
    """struct(iou, both_empty) of two arrays of boxes (x0, y0, x1, y1 as doubles): see regions.union_iou."""
    return F.arrow_udf(_union, "struct<iou:double,both_empty:boolean>")(gt, pred)


def _weight(boxes: pa.Array) -> pa.Array:
    n, at, found = fields(boxes)
    whole = np.stack([found[c].cast(pa.int64()).to_numpy(zero_copy_only=False) for c in (*SIDES, "w")], -1)
    out = np.zeros(len(n), int)
    for like in _alike(8, n):
        if not (rows := int(n[like[0]])):
            continue
        box = whole[at[like][:, None] + np.arange(rows)]
        xs, ys = np.sort(box[:, :, 0:4:2].reshape(len(like), -1), -1), np.sort(box[:, :, 1:4:2].reshape(len(like), -1), -1)
        on_x, on_y = _inside(box, 0, 2, xs), _inside(box, 1, 3, ys)
        most = np.zeros((len(like), ys.shape[1] - 1, xs.shape[1] - 1), int)
        for k in range(rows):
            np.maximum(most, np.where(on_y[:, k, :, None] & on_x[:, k, None], box[:, k, 4, None, None], 0), out=most)
        out[like] = (np.diff(ys)[:, :, None] * np.diff(xs)[:, None] * most).sum((1, 2))
    return pa.array(out)


def largest_weights(boxes: Column) -> Column:
    """The sum over whole cells of the largest weight of the boxes (x0, y0, x1, y1, w, whole numbers) on a cell; cells on no box, and weights below 0, count as 0."""
    return F.arrow_udf(_weight, "bigint")(boxes)
