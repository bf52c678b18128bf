"""Rectangles as columns: struct<x, y, width, height>, y upwards or downwards as the space says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))])


def right(r: Column) -> Column:
    return r["x"] + r["width"]


def bottom(r: Column) -> Column:
    return r["y"] + r["height"]


def area(r: Column) -> Column:
    return r["width"] * r["height"]


def valid(r: Column, normalized: bool = False) -> Column:
    """Finite, of no negative size, and inside the unit square if normalised."""
    finite = F.lit(True)
    for name in ("x", "y", "width", "height"):
        finite = finite & r[name].isNotNull() & ~F.isnan(r[name]) & (F.abs(r[name]) < float("inf"))
    fine = finite & (r["width"] >= 0) & (r["height"] >= 0)
    return fine & (r["x"] >= 0) & (r["y"] >= 0) & (right(r) <= 1) & (bottom(r) <= 1) if normalized else fine


def intersection(a: Column, b: Column) -> Column:
    """Null where they touch or are apart."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    width, height = F.least(right(a), right(b)) - x, F.least(bottom(a), bottom(b)) - y
    return F.when((width > 0) & (height > 0), rect(x, y, width, height))


def iou(a: Column, b: Column) -> Column:
    shared = F.coalesce(area(intersection(a, b)), F.lit(0.0))
    return F.when(shared > 0, shared / (area(a) + area(b) - shared)).otherwise(0.0)


def contains(outer: Column, inner: Column) -> Column:
    return (inner["x"] >= outer["x"]) & (inner["y"] >= outer["y"]) & (right(inner) <= right(outer)) & (bottom(inner) <= bottom(outer))


def expanded(r: Column, margin: Column, clip: Column | None = None) -> Column:
    grown = rect(r["x"] - margin, r["y"] - margin, r["width"] + 2 * margin, r["height"] + 2 * margin)
    return grown if clip is None else intersection(grown, clip)


def translated(r: Column, dx: Column, dy: Column) -> Column:
    return rect(r["x"] + dx, r["y"] + dy, r["width"], r["height"])


def raster_size(points: Column, dpi: int) -> Column:
    """Pixels of a length in points."""
    if not 1 <= dpi <= 1200:
        raise ValueError("dpi must be 1 to 1200")
    return F.ceil(points * dpi / 72)


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """Brightness of a pixel from 0 to 255, in whole numbers."""
    return F.floor((299 * red + 587 * green + 114 * blue) / 1000)


def compatible(a: Column, b: Column) -> Column:
    """Whether two rectangles are of one space and unit, so that they may be compared."""
    return (a["space"] == b["space"]) & (a["unit"] == b["unit"])
