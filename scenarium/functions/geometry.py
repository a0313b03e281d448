"""Boxes as four columns x1, y1, x2, y2 (absolute, doubles); all expressions stay in generated code."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @staticmethod
    def from_array(c: Column) -> Box:
        return Box(*(F.get(c, F.lit(i)) for i in range(4)))

    @staticmethod
    def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
        return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)

    @property
    def width(self) -> Column:
        return F.greatest(F.lit(0.0), self.x2 - self.x1)

    @property
    def height(self) -> Column:
        return F.greatest(F.lit(0.0), self.y2 - self.y1)

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2.0

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2.0

    @property
    def area(self) -> Column:
        return self.width * self.height


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection."""
    return Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2)).area


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where the union has no area."""
    inter = overlap(a, b)
    union = a.area + b.area - inter
    return F.when(union <= 0, 0.0).otherwise(F.try_divide(inter, union))


def containment(inner: Box, outer: Box) -> Column:
    """The part of ``inner`` that ``outer`` covers, 0 where ``inner`` has no area."""
    return F.when(inner.area <= 0, 0.0).otherwise(F.try_divide(overlap(inner, outer), inner.area))


def area_ratio(b: Box, width: Column, height: Column) -> Column:
    """A box's part of its image; an error on images without area."""
    return F.when((width <= 0) | (height <= 0), F.raise_error(F.lit("width and height must be positive")).cast("double")).otherwise(b.area / (width * height))


def clipped(b: Box, width: Column, height: Column) -> Box:
    """A box within its image, swapped sides put right."""
    x = lambda c: F.greatest(F.lit(0.0), F.least(c.cast("double"), width.cast("double")))
    y = lambda c: F.greatest(F.lit(0.0), F.least(c.cast("double"), height.cast("double")))
    return Box(F.least(x(b.x1), x(b.x2)), F.least(y(b.y1), y(b.y2)), F.greatest(x(b.x1), x(b.x2)), F.greatest(y(b.y1), y(b.y2)))


def rescaled(b: Box, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Box:
    return Box(b.x1 * to_w / from_w, b.y1 * to_h / from_h, b.x2 * to_w / from_w, b.y2 * to_h / from_h)


def size_class(ratio: Column) -> Column:
    return F.when(ratio < 0.01, "tiny").when(ratio < 0.05, "small").when(ratio < 0.15, "medium").when(ratio < 0.35, "large").otherwise("dominant")


def grid_place(b: Box, width: Column, height: Column) -> Column:
    """Column and row of the box's centre in a 3 by 3 grid, e.g. ``left-top``."""
    column = F.when(b.cx < width / 3, "left").when(b.cx < 2 * width / 3, "center").otherwise("right")
    row = F.when(b.cy < height / 3, "top").when(b.cy < 2 * height / 3, "middle").otherwise("bottom")
    return F.concat(column, F.lit("-"), row)


def central(b: Box, width: Column, height: Column) -> Column:
    return grid_place(b, width, height) == "center-middle"


def salience(b: Box, confidence: Column, width: Column, height: Column) -> Column:
    bonus = F.when(central(b, width, height), 0.15).otherwise(0.0)
    return F.least(0.65 * confidence + 0.35 * F.least(area_ratio(b, width, height) / 0.35, F.lit(1.0)) + bonus, F.lit(1.0))
