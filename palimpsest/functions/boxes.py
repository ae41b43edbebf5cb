"""Box and polygon arithmetic. A box is four columns; a polygon an array of {x, y}."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> "Box":
        return cls(*[F.col(f"{prefix}{name}{suffix}") for name in ("x0", "y0", "x1", "y1")])

    @property
    def area(self) -> Column:
        return (self.x1 - self.x0) * (self.y1 - self.y0)


def finite(*values: Column) -> Column:
    """Every value is present and an ordinary number."""
    ok = F.lit(True)
    for value in values:
        number = value.cast("double")
        ok = ok & value.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return ok


def overlaps(a: Box, b: Box) -> Column:
    """Strict overlap: touching edges do not count."""
    return (a.x0 < b.x1) & (a.x1 > b.x0) & (a.y0 < b.y1) & (a.y1 > b.y0)


def intersection(a: Box, b: Box) -> Column:
    width = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    height = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    shared = intersection(a, b)
    return F.coalesce(F.try_divide(shared, a.area + b.area - shared), F.lit(0.0))


def containment(inner: Box, outer: Box) -> Column:
    """Share of `inner` that lies inside `outer`."""
    return F.coalesce(F.try_divide(intersection(inner, outer), inner.area), F.lit(0.0))


def area_ratio(part: Box, whole: Box) -> Column:
    return F.coalesce(F.try_divide(part.area, whole.area), F.lit(0.0))


def poly_area(points: Column) -> Column:
    """Shoelace area of an array of {x, y}."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    total = F.aggregate(cross, F.lit(0.0), lambda acc, term: acc + term)
    return F.abs(total) / 2


def poly_bounds(points: Column) -> Box:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def page_region(points: Column, width: Column, height: Column, crop_x: Column, crop_y: Column) -> Box:
    """Bounds of the points in crop-box coordinates, clamped to the page, never reversed."""
    b = poly_bounds(points)
    x0, x1 = F.greatest(b.x0 - crop_x, F.lit(0.0)), F.least(b.x1 - crop_x, width)
    y0, y1 = F.greatest(b.y0 - crop_y, F.lit(0.0)), F.least(b.y1 - crop_y, height)
    return Box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def expand(b: Box, amount: float, width: Column, height: Column) -> Box:
    return Box(F.greatest(b.x0 - amount, F.lit(0.0)), F.greatest(b.y0 - amount, F.lit(0.0)),
               F.least(b.x1 + amount, width), F.least(b.y1 + amount, height))


def to_pixels(b: Box, page_w: Column, page_h: Column, pixel_w: Column, pixel_h: Column) -> Box:
    """Page points (origin bottom left) to the pixel box (origin top left) that covers them."""
    return Box(
        F.greatest(F.floor(b.x0 / page_w * pixel_w), F.lit(0)),
        F.greatest(F.floor((page_h - b.y1) / page_h * pixel_h), F.lit(0)),
        F.least(F.ceil(b.x1 / page_w * pixel_w), pixel_w),
        F.least(F.ceil((page_h - b.y0) / page_h * pixel_h), pixel_h),
    )


def snapped(b: Box) -> Box:
    """The whole pixels a box touches."""
    return Box(F.floor(b.x0), F.floor(b.y0), F.ceil(b.x1), F.ceil(b.y1))
