"""Validity predicates on instances, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relata.params import AuditRules

INFINITY = float("inf")


def finite_number(c: Column) -> Column:
    """Neither null, NaN nor infinite. (A typed schema has already made booleans null.)"""
    c = c.cast("double")
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INFINITY), F.lit(False))


def finite_vector(c: Column, n: int) -> Column:
    return F.coalesce((F.size(c) == n) & F.forall(c, finite_number), F.lit(False))


def geometric_valid(position: Column, scale: Column, corners: Column) -> Column:
    positive = F.coalesce(F.forall(scale, lambda s: s > 0), F.lit(False))
    eight = F.coalesce((F.size(corners) == 8) & F.forall(corners, lambda p: finite_vector(p, 3)), F.lit(False))
    return finite_vector(position, 3) & finite_vector(scale, 3) & positive & eight


def normalized_category(category: Column, present: Column | None = None) -> Column:
    """Lower case, without white space of any kind at its ends.  A missing category is empty; where ``present`` tells that a null was written out, it is 'none'."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(category, r"^(?U)\s+", ""), r"(?U)\s+$", ""))
    absent = F.lit("") if present is None else F.when(present, F.lit("none")).otherwise(F.lit(""))
    return F.coalesce(clean, absent)


def valid_box(box: Column) -> Column:
    return F.when(finite_vector(box, 4), box)


def _side(box: Column, axis: int) -> Column:
    return F.get(box, F.lit(axis + 2)) - F.get(box, F.lit(axis))


def oracle_valid(geometric: Column, box: Column, width: Column, height: Column, rules: AuditRules = AuditRules()) -> Column:
    """Geometrically valid, with a box that is large enough and does not cover too much of the image."""
    x, y = _side(box, 0), _side(box, 1)
    sized = (x >= rules.minimum_side_px) & (y >= rules.minimum_side_px) & (x * y >= rules.minimum_area_px2)
    covers = F.when((width > 0) & (height > 0), x * y / (width * height))
    return geometric & finite_vector(box, 4) & F.coalesce(sized & (covers <= rules.maximum_coverage), F.lit(False))


def interior_valid(box: Column, width: Column, height: Column, margin: Column | float = 5.0, mode: str = "box", kind: str = "pixels") -> Column:
    """The box, or its centre, keeps a margin (pixels, or a fraction of each side of the image) from every border."""
    margin = F.lit(margin) if not isinstance(margin, Column) else margin
    mx, my = (margin, margin) if kind == "pixels" else (margin * width, margin * height)
    x0, y0, x1, y1 = (F.get(box, F.lit(k)) for k in range(4))
    if mode == "center":
        x0 = x1 = (x0 + x1) / 2
        y0 = y1 = (y0 + y1) / 2
    inside = (x0 >= mx) & (y0 >= my) & (x1 <= width - mx) & (y1 <= height - my)
    return finite_vector(box, 4) & F.coalesce(inside, F.lit(False))


def strict_double(c: Column) -> Column:
    """The number a text or number stands for, null unless finite."""
    value = c.try_cast("double")
    return F.when(finite_number(value), value)


def strict_long(c: Column) -> Column:
    """The whole number a value stands for, null if it has a fraction."""
    value = strict_double(c)
    return F.when((value == F.floor(value)) & (F.abs(value) < 9.2e18), value.cast("long"))
