"""Box geometry as Column functions. A box is four columns x0, y0, x1, y1 in the range 0 to 1000."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> dict[str, Column]:
    return {s: F.col(f"{prefix}{s}").cast("double") for s in SIDES}


def area(b: dict[str, Column]) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area that two boxes share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: dict[str, Column], b: dict[str, Column], eps: float | None = None) -> Column:
    """Intersection over union; 0 where the union has no area. With eps sides below 0 count as 0 and eps is added to the union."""
    both = overlap(a, b)
    if eps is not None:
        side = lambda c: F.greatest(c["x1"] - c["x0"], F.lit(0.0)) * F.greatest(c["y1"] - c["y0"], F.lit(0.0))
        return both / (side(a) + side(b) - both + eps)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def diou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """IoU less the squared distance of the centres over the squared diagonal of the enclosing box."""
    dx, dy = ((a[p] + a[q] - b[p] - b[q]) / 2 for p, q in (("x0", "x1"), ("y0", "y1")))
    w, h = (F.greatest(a[q], b[q]) - F.least(a[p], b[p]) for p, q in (("x0", "x1"), ("y0", "y1")))
    diagonal = w * w + h * h
    return iou(a, b) - F.when(diagonal > 0, (dx * dx + dy * dy) / diagonal).otherwise(0.0)


def compatible(a: Column, b: Column) -> Column:
    """Labels that may match: equal ones, or ``both`` with a known class."""
    known = lambda c: c.isin("artifact", "misalignment")
    return (a == b) | ((a == "both") & known(b)) | ((b == "both") & known(a))
