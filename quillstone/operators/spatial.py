"""Box-to-grid jobs: sparse penalty maps over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import stacks


def cells(boxes: DataFrame, grid: int = 64, extent: int = 1000) -> DataFrame:
    """Boxes exploded to the cells (y, x) they cover; corners are truncated and clamped, degenerate boxes go.

    An explode of two sequences in place of a range join: at most grid * grid rows a box.
    """
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) * grid / extent), F.lit(0)), F.lit(grid)).cast("int")
    b = boxes.withColumns({f"c{c}": at(c) for c in ("x0", "y0", "x1", "y1")}).where("cx0 < cx1 and cy0 < cy1")
    rows = b.withColumn("y", F.explode(F.sequence("cy0", F.col("cy1") - 1)))
    return rows.withColumn("x", F.explode(F.sequence("cx0", F.col("cx1") - 1))).drop("cx0", "cy0", "cx1", "cy1")


def covered_weight(boxes: DataFrame, grid: int = 64, extent: int = 1000) -> DataFrame:
    """(image_id, label, weight): over the grid's cells, the sum of the largest importance (100 where null) of the label's boxes on a cell.

    No cell becomes a row: the boxes of an image and label, which are few, are cut at their own distinct edges, and each of
    these rectangles counts with its number of cells. One shuffle by image and label.
    """
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) * grid / extent), F.lit(0)), F.lit(grid)).cast("int")
    b = boxes.select("image_id", "label", *[at(c).alias(c) for c in ("x0", "y0", "x1", "y1")], F.coalesce(F.col("importance").cast("long"), F.lit(100)).alias("w")).where("x0 < x1 and y0 < y1")
    per = b.groupBy("image_id", "label").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "w")).alias("b"))
    return per.select("image_id", "label", stacks.largest_weights(F.col("b")).alias("weight"))


def map_scalar_of_boxes(boxes: DataFrame, alpha: float, other: float, grid: int = 64) -> DataFrame:
    """(image_id, scalar): map_scalar of the penalty map with alpha for misalignment and other for the rest, without the map itself.

    Whole numbers are summed and divided once, so that results do not depend on the order of rows.
    """
    of = lambda yes: F.sum(F.when((F.col("label") == "misalignment") == yes, F.col("weight")).otherwise(0))
    sums = covered_weight(boxes, grid).groupBy("image_id").agg(of(True).alias("m"), of(False).alias("o"))
    return sums.select("image_id", (-(alpha * F.col("m") + other * F.col("o")) / (100 * grid * grid)).alias("scalar"))


def label_penalties(boxes: DataFrame, alpha: dict[str, float], other: float, grid: int = 64, stacking: bool = False, weighted: bool = True, normalised: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """(image_id, label, y, x, penalty) at the cells that boxes of a label cover; a null label is an artifact.

    The penalty of a label is alpha (other for labels that alpha does not name), times the column scale where boxes have one, times
    1 - coverage for the classes in normalised (misalignment; artifact for all else), and least at least. Weighted by importance, overlaps take the largest
    weight (with stacking their sum; null counts as 100), and cells of a positive weight get least at least; without
    weights a cell counts once, or with stacking each of its boxes. Coverage is the share of cells of the label: those with a
    positive weight, or, stacked without weights, the number of boxes on them.

    One shuffle, of boxes by image; cells of an image never leave its task.
    """
    scale = "scale" in boxes.columns
    own = boxes.withColumn("label", F.coalesce("label", F.lit("artifact"))).repartition("image_id")
    weight = F.coalesce(F.col("importance") / 100.0, F.lit(1.0)) if weighted else F.lit(1.0)
    by_label = cells(own, grid).groupBy("image_id", "label", "y", "x").agg((F.sum if stacking else F.max)(weight).alias("w"), *([F.max("scale").alias("scale")] if scale else []))
    if weighted and not stacking:
        by_label = by_label.withColumn("w", F.greatest("w", F.lit(0.0)))
    a = F.lit(other)
    for label, value in alpha.items():
        a = F.when(F.col("label") == label, value).otherwise(a)
    if scale:
        a = a * F.col("scale")
    if normalised:
        active = F.when(F.col("w") > 0, 1.0).otherwise(0.0) if weighted else F.col("w")
        coverage = F.sum(active).over(Window.partitionBy("image_id", "label")) / (grid * grid)  # a label has grid * grid cells at most
        kind = F.when(F.col("label") == "misalignment", "misalignment").otherwise("artifact")
        a = F.when(kind.isin(*normalised), a * (1 - coverage)).otherwise(a)
    penalty = F.greatest(a, F.lit(least)) * F.col("w")
    if weighted:
        penalty = F.when(F.col("w") > 0, F.greatest(penalty, F.lit(least))).otherwise(penalty)
    return by_label.select("image_id", "label", "y", "x", penalty.alias("penalty"))


def penalty_map(boxes: DataFrame, alpha: dict[str, float], other: float, grid: int = 64, stacking: bool = False, weighted: bool = True, normalised: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """(image_id, y, x, penalty): label_penalties of all labels added; only covered cells are rows."""
    return label_penalties(boxes, alpha, other, grid, stacking, weighted, normalised, least).groupBy("image_id", "y", "x").agg(F.sum("penalty").alias("penalty"))


def map_scalar(penalties: DataFrame, grid: int = 64) -> DataFrame:
    """(image_id, scalar): the mean over all cells of 0 less the penalty; absent cells count as 0."""
    return penalties.groupBy("image_id").agg((-F.sum("penalty") / (grid * grid)).alias("scalar"))


def reward_map(boxes: DataFrame, scalars: DataFrame, alpha: dict[str, float], other: float, grid: int = 64, least: float = 0.0, **options) -> DataFrame:
    """(image_id, y, x, value) at covered cells: the image's scalar less the penalties of its labels, each scaled by the column ``scale`` of scalars and floored by itself.

    scalars: image_id, scalar, scale (the deviation of the image's group, or 1), a row per image. Cells that no box covers have the scalar itself.
    options are those of label_penalties.
    """
    own = boxes.join(scalars.select("image_id", "scale").hint("merge"), "image_id")
    p = penalty_map(own, alpha, other, grid, least=least, **options).join(scalars.hint("merge"), "image_id")
    return p.select("image_id", "y", "x", (F.col("scalar") - F.col("penalty")).alias("value"))


def penalty_telemetry(boxes: DataFrame, images: DataFrame, alpha: float, other: float, grid: int = 64) -> DataFrame:
    """Per class the mean penalty of a map over the images that have the class, and their number; then boxes an image and the share of images with boxes.

    Whatever is not misalignment counts as artifact.
    """
    named = boxes.withColumn("label", F.when(F.col("label") == "misalignment", "misalignment").otherwise("artifact"))
    weight = F.when(F.col("label") == "misalignment", alpha).otherwise(other)
    means = covered_weight(named, grid).groupBy("label").agg(F.count("*").alias("n_images"), (F.sum("weight") / F.count("*") / (100 * grid * grid)).alias("mean")).select("label", "n_images", (F.col("mean") * weight).alias("penalty"))
    counts = images.select("image_id").join(boxes.groupBy("image_id").agg(F.count("*").alias("n")).hint("merge"), "image_id", "left")
    of_all = counts.agg((F.sum(F.coalesce("n", F.lit(0))) / F.count("*")).alias("boxes"), F.avg((F.coalesce("n", F.lit(0)) > 0).cast("double")).alias("with_boxes"))
    return means.join(F.broadcast(of_all))  # one row
