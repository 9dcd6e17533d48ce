"""Distances and box measures, as columns.  Boxes are (x0, y0, x1, y1) arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(c: Column, k: int) -> Column:
    return F.get(c, F.lit(k))


def euclidean(a: Column, b: Column) -> Column:
    """Null if a coordinate is missing or not finite."""
    total = sum((_at(a, k) - _at(b, k)) * (_at(a, k) - _at(b, k)) for k in range(3))
    return F.when(~F.isnan(total) & (total < float("inf")), F.sqrt(total))


def area(box: Column) -> Column:
    return F.greatest(_at(box, 2) - _at(box, 0), F.lit(0.0)) * F.greatest(_at(box, 3) - _at(box, 1), F.lit(0.0))


def visible_fraction(box: Column, width: Column, height: Column) -> Column:
    """Share of the box inside the image, 0 for a box without area."""
    width, height = width.cast("double"), height.cast("double")
    clip = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), top)
    seen = F.greatest(clip(_at(box, 2), width) - clip(_at(box, 0), width), F.lit(0.0)) * F.greatest(clip(_at(box, 3), height) - clip(_at(box, 1), height), F.lit(0.0))
    return F.when(area(box) > 0, F.least(F.greatest(seen / area(box), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def intersection(a: Column, b: Column) -> Column:
    overlap = lambda k: F.greatest(F.least(_at(a, k + 2), _at(b, k + 2)) - F.greatest(_at(a, k), _at(b, k)), F.lit(0.0))
    return overlap(0) * overlap(1)


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def intersection_over_smaller(a: Column, b: Column) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(0.0)


def center_distance(a: Column, b: Column) -> Column:
    gap = lambda k: (_at(a, k) + _at(a, k + 2)) / 2 - (_at(b, k) + _at(b, k + 2)) / 2
    return F.sqrt(gap(0) * gap(0) + gap(1) * gap(1))


def area_fraction(box: Column, width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), area(box) / (width * height))


def shorter_side(box: Column) -> Column:
    return F.least(_at(box, 2) - _at(box, 0), _at(box, 3) - _at(box, 1))


def border_margin(box: Column, width: Column, height: Column) -> Column:
    return F.least(_at(box, 0), _at(box, 1), width - _at(box, 2), height - _at(box, 3))


def both(a: Column, b: Column) -> Column:
    """The smaller of two measures, null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
