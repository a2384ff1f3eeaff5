"""Audit, scaling and jitter of box tables with columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")
EXTENT = 1000


def audit(boxes: DataFrame) -> DataFrame:
    """boxes with ``errors``, the list of what is wrong with each; a null coordinate ends the audit of its box."""
    c = {s: F.col(s) for s in SIDES}
    null = c["x0"].isNull() | c["y0"].isNull() | c["x1"].isNull() | c["y1"].isNull()
    tests = [F.when((c[s] < 0) | (c[s] > EXTENT), f"{s} out of range") for s in SIDES]
    tests += [F.when(c["y0"] >= c["y1"], "y0 >= y1"), F.when(c["x0"] >= c["x1"], "x0 >= x1")]
    return boxes.withColumn("errors", F.when(null, F.array(F.lit("not numeric"))).otherwise(F.array_compact(F.array(*tests))))


def audit_counts(audited: DataFrame, record: str) -> DataFrame:
    """boxes, invalid_boxes, records and invalid_records of audit()'s rows, by the column that names a record; of its records each is one row before the sum."""
    bad = F.size("errors") > 0
    per = audited.groupBy(record).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("boxes"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_boxes"), F.count("*").alias("records"), F.count_if(F.col("bad") > 0).alias("invalid_records"))


def audited_records(records: DataFrame, audited: DataFrame, record: str, skip_invalid: bool = False) -> DataFrame:
    """records with the column invalid, the number of their boxes with errors; with skip_invalid only those that have none. Records without boxes stay."""
    bad = audited.where(F.size("errors") > 0).groupBy(record).agg(F.count("*").alias("invalid"))
    out = records.join(bad.hint("merge"), record, "left").withColumn("invalid", F.coalesce("invalid", F.lit(0)))
    return out.where("invalid = 0") if skip_invalid else out


def to_pixels(boxes: DataFrame, width: Column, height: Column, base: int = EXTENT, clamped: bool = False) -> DataFrame:
    """Coordinates of 0..base (1000, or 512 in old records) as pixels, truncated; corners ordered, boxes without area left out. clamped keeps them in the image."""
    plain = lambda c, size: F.floor(F.col(c) * size / base).cast("long")
    at = lambda c, size: F.least(F.greatest(plain(c, size), F.lit(0)), size.cast("long")) if clamped else plain(c, size)
    p = {"x0": at("x0", width), "y0": at("y0", height), "x1": at("x1", width), "y1": at("y1", height)}
    ordered = {"x0": F.least(p["x0"], p["x1"]), "y0": F.least(p["y0"], p["y1"]), "x1": F.greatest(p["x0"], p["x1"]), "y1": F.greatest(p["y0"], p["y1"])}
    return boxes.withColumns(ordered).where("x0 < x1 and y0 < y1")


def jitter(boxes: DataFrame, epochs: int, most: int, seed: str, *key: str) -> DataFrame:
    """boxes once per epoch: epoch 0 as they are, later ones moved by up to ``most`` per coordinate.

    The shift depends on seed, epoch, key and coordinate only. Results are clamped to 0..1000 and put in
    order, and a side is at least 1 long where there is room.
    """
    rows = boxes.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))

    def moved(side: str) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(seed), "epoch", *key, F.lit(side)))
        shift = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (2 * most + 1) - most
        return F.when(F.col("epoch") == 0, F.col(side)).otherwise(F.least(F.greatest(F.col(side) + shift, F.lit(0)), F.lit(EXTENT)))

    rows = rows.withColumns({f"_{s}": moved(s) for s in SIDES})
    out = {}
    for a, b in (("x0", "x1"), ("y0", "y1")):
        low, high = F.least(f"_{a}", f"_{b}"), F.greatest(f"_{a}", f"_{b}")
        flat = (low == high) & (F.col("epoch") > 0)
        out[a] = F.when(flat & (high >= EXTENT), low - 1).otherwise(low)
        out[b] = F.when(flat & (high < EXTENT), high + 1).otherwise(high)
    return rows.withColumns(out).drop(*[f"_{s}" for s in SIDES])


def smart_resize(height: Column, width: Column, factor: int = 32, least: int = 256 * 32 * 32, most: int = 1280 * 32 * 32) -> Column:
    """struct(height, width): sides as multiples of factor, within a pixel budget; null above an aspect of 200.

    Sides are rounded half to even; where the budget is missed both are scaled by one ratio and rounded down.
    """
    h, w = height.cast("double"), width.cast("double")
    near = lambda side: F.greatest(F.bround(side / factor), F.lit(1.0)) * factor
    down = lambda side: F.greatest(F.floor(side / factor), F.lit(1)) * factor
    pixels = near(h) * near(w)
    shrink, grow = F.sqrt(h * w / most), F.sqrt(least / h / w)
    side = lambda s: F.when(pixels > most, down(s / shrink)).when(pixels < least, down(s * grow)).otherwise(near(s)).cast("long")
    return F.when(F.greatest(h, w) <= 200 * F.least(h, w), F.struct(side(h).alias("height"), side(w).alias("width")))
