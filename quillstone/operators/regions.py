"""Areas of boxes and of heat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import stacks

REGIONS = [["upper-left", "upper-center", "upper-right"], ["middle-left", "center", "middle-right"], ["lower-left", "lower-center", "lower-right"]]


def union_iou(gt: Column, pred: Column) -> Column:
    """struct(iou, both_empty) of two arrays of boxes (x0, y0, x1, y1) as areas: 1 and true if both are empty, 0 if one is.

    Boxes of four zeros count as none. The boxes, which are few, are cut at their own edges; no pixels.
    """
    return stacks.union_of_boxes(gt, pred)


def class_boxes(images: DataFrame, gt: DataFrame, pred: DataFrame, classes: tuple[str, ...] = ("artifact", "misalignment")) -> DataFrame:
    """(image_id, class, gt, pred) for every image and class, with the boxes of the class; ``both`` counts in each class."""
    corner = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    side = lambda df, k: df.select("image_id", "label", F.when(F.lit(k == 0), corner).alias("g"), F.when(F.lit(k == 1), corner).alias("p"))
    per = side(gt, 0).unionByName(side(pred, 1)).groupBy("image_id").agg(F.collect_list(F.struct("label", "g", "p")).alias("b"))
    every = images.select("image_id").join(per.hint("merge"), "image_id", "left").select("image_id", "b", F.explode(F.array(*map(F.lit, classes))).alias("class"))
    of = lambda s: F.transform(F.filter("b", lambda x: x["label"].isin("both") & x[s].isNotNull() | (x["label"] == F.col("class")) & x[s].isNotNull()), lambda x: x[s])
    return every.select("image_id", "class", of("g").alias("gt"), of("p").alias("pred"))


def _union_means(rows: DataFrame) -> DataFrame:
    r = rows.select("class", union_iou(F.col("gt"), F.col("pred")).alias("u"), (F.coalesce(F.size("gt"), F.lit(0)) <= 0).alias("no_gt"), (F.coalesce(F.size("pred"), F.lit(0)) <= 0).alias("no_pred"))
    mean = lambda c, name: F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(name)
    u = F.col("u.iou")
    return r.groupBy("class").agg(
        F.count("*").alias("n"), mean(u, "mean_iou"), mean(F.when(~F.col("u.both_empty"), u), "mean_iou_non_empty"), mean(u >= 0.5, "share_50"), F.count_if("u.both_empty").alias("both_empty"),
        F.count_if("no_gt").alias("no_gt"), mean(F.col("no_gt"), "no_gt_share"), F.count_if("no_pred").alias("no_pred"), mean(F.col("no_pred"), "no_pred_share"), mean(F.when(F.col("no_gt"), F.col("no_pred")), "clean_accuracy"),
    )


def union_report(rows: DataFrame, combined: bool = False) -> DataFrame:
    """Per class of (image_id, class, gt, pred): mean union IoU with and without images empty on both sides, share at 0.5, counts and shares of empty sides.

    With combined a row of that name has the means of the classes' means, and the sums of their counts.
    """
    report = _union_means(rows)
    if combined:
        of = lambda c, t: (F.avg(c) if t == "double" else F.sum(c)).alias(c)
        # a row per class is read twice, the boxes are not
        both = report.withColumn("class", F.explode(F.array("class", F.lit("combined"))))
        report = both.groupBy("class").agg(*[of(c, t) for c, t in report.dtypes if c != "class"])
    return report.withColumns({c: F.round(c, 6) for c, t in report.dtypes if t == "double"})


def hot_regions(cells: DataFrame, size: int, threshold: float) -> DataFrame:
    """(image_id, label, region): the ninths of a size x size map whose mean heat exceeds the threshold; cells: image_id, label, y, x, heat.

    A ninth has size // 3 cells a side, so that the last size % 3 rows and columns are in none; absent cells are 0.
    """
    third = size // 3
    name = F.element_at(F.array(*[F.lit(r) for row in REGIONS for r in row]), (F.col("row") * 3 + F.col("column") + 1).cast("int"))
    inside = cells.where((F.col("y") < 3 * third) & (F.col("x") < 3 * third)).withColumns({"row": F.floor(F.col("y") / third), "column": F.floor(F.col("x") / third)})
    mean = inside.groupBy("image_id", "label", "row", "column").agg((F.sum("heat") / (third * third)).alias("mean")).where(F.col("mean") > threshold)
    return mean.select("image_id", "label", name.alias("region"))


def region_phrases(regions: DataFrame) -> DataFrame:
    """(image_id, phrases): hot_regions() as texts "misalignment in r" and "artifact in r", those of misalignment first, regions in the order of rows."""
    place = F.array_position(F.array(*[F.lit(r) for row in REGIONS for r in row]), F.col("region"))
    told = F.struct((F.col("label") != "misalignment").alias("a"), place.alias("b"), F.concat_ws(" in ", "label", "region").alias("text"))
    return regions.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(told)), lambda t: t["text"]).alias("phrases"))


def grid_cells(images: DataFrame, rows: str = "rows", columns: str = "columns", width: str = "width", height: str = "height") -> DataFrame:
    """Images exploded to the crops of their grid: (cell, left, upper, right, lower); a side's remainder is in no cell."""
    high, wide = F.floor(F.col(height) / F.col(rows)), F.floor(F.col(width) / F.col(columns))
    i, j = F.floor(F.col("cell") / F.col(columns)), F.col("cell") % F.col(columns)
    each = images.where((F.col(rows) > 0) & (F.col(columns) > 0)).withColumn("cell", F.explode(F.sequence(F.lit(0), (F.col(rows) * F.col(columns) - 1).cast("int"))))
    return each.withColumns({"left": (j * wide).cast("long"), "upper": (i * high).cast("long"), "right": ((j + 1) * wide).cast("long"), "lower": ((i + 1) * high).cast("long")})


def smoothed(cells: DataFrame, kernel: int, size: int, value: str = "value") -> DataFrame:
    """cells (keys, y, x, value) of size x size maps, smoothed by a Gaussian kernel of odd width (one more if even), sigma a third of it.

    Cells beyond the edge are mirrored without repeating it. Absent cells count as 0; every cell near a covered one has a row.
    Each cell goes to the cells around it, kernel * kernel rows, and the shares are summed.
    """
    from math import exp

    k = kernel if kernel % 2 else kernel + 1
    half, sigma = k // 2, k / 3
    if half >= size:
        raise ValueError(f"a kernel of {k} is too wide for {size} cells")
    plain = [exp(-0.5 * ((i - half) / sigma) ** 2) for i in range(k)]
    total = sum(plain) ** 2
    weights = [(i - half, j - half, plain[i] * plain[j] / total) for i in range(k) for j in range(k)]
    keys = [c for c in cells.columns if c not in ("y", "x", value)]
    # a padded cell at p shows the cell |p|, or 2 (size - 1) - p; so a cell stands at itself and at its mirror images
    places = lambda c: F.filter(F.array_distinct(F.array(F.col(c), -F.col(c), F.lit(2 * (size - 1)) - F.col(c))), lambda p: (p >= -half) & (p < size + half))
    spread = cells.withColumn("py", F.explode(places("y"))).withColumn("px", F.explode(places("x")))
    table = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in weights])).alias("k")
    moved = spread.select(*keys, "py", "px", value, table).select(*keys, (F.col("py") + F.col("k.a")).alias("y"), (F.col("px") + F.col("k.b")).alias("x"), (F.col(value) * F.col("k.w")).alias(value))
    return moved.where((F.col("y") >= 0) & (F.col("y") < size) & (F.col("x") >= 0) & (F.col("x") < size)).groupBy(*keys, "y", "x").agg(F.sum(value).alias(value))
