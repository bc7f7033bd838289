"""Geometry of half-open boxes [x1, x2) × [y1, y2), held as structs or as prefixed columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> Column:
    """Struct of the four columns with this prefix."""
    return F.struct(*[F.col(prefix + s).alias(s) for s in SIDES])


def _v(b: Column, side: str) -> Column:
    return b.getField(side)


def width(b):
    return _v(b, "x2") - _v(b, "x1")


def height(b):
    return _v(b, "y2") - _v(b, "y1")


def box_area(b: Column) -> Column:
    zero = F.lit(0)
    return F.greatest(width(b), zero).cast("bigint") * F.greatest(height(b), zero)


def center_x(b):
    return (_v(b, "x1") + _v(b, "x2")) / 2.0


def center_y(b):
    return (_v(b, "y1") + _v(b, "y2")) / 2.0


def center_dist(a, b):
    return F.hypot(center_x(a) - center_x(b), center_y(a) - center_y(b))


def _make(x1, y1, x2, y2) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def clip_box(b: Column, w, h) -> Column:
    """Box limited to a page of ``w`` × ``h``; null when nothing is left."""
    within = lambda v, top: F.greatest(F.lit(0), F.least(top, v))
    out = _make(within(_v(b, "x1"), w), within(_v(b, "y1"), h), within(_v(b, "x2"), w), within(_v(b, "y2"), h))
    return F.when((_v(out, "x2") > _v(out, "x1")) & (_v(out, "y2") > _v(out, "y1")), out)


def pad_box(b: Column, pad, w, h) -> Column:
    zero = F.lit(0)
    return _make(F.greatest(zero, _v(b, "x1") - pad), F.greatest(zero, _v(b, "y1") - pad),
                 F.least(w, _v(b, "x2") + pad), F.least(h, _v(b, "y2") + pad))


def enclose(a: Column, b: Column) -> Column:
    return _make(F.least(_v(a, "x1"), _v(b, "x1")), F.least(_v(a, "y1"), _v(b, "y1")),
                 F.greatest(_v(a, "x2"), _v(b, "x2")), F.greatest(_v(a, "y2"), _v(b, "y2")))


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0)
    w = F.least(_v(a, "x2"), _v(b, "x2")) - F.greatest(_v(a, "x1"), _v(b, "x1"))
    h = F.least(_v(a, "y2"), _v(b, "y2")) - F.greatest(_v(a, "y1"), _v(b, "y1"))
    return F.greatest(w, zero).cast("bigint") * F.greatest(h, zero)


def iou(a: Column, b: Column, style: str = "plain") -> Column:
    """Intersection over union. ``plain``: 0 when the union is empty; ``eps``: union + 1e-6;
    ``floor``: union at least 1."""
    inter = intersection(a, b)
    union = box_area(a) + box_area(b) - inter
    if style == "eps":
        return F.when(inter == 0, 0.0).otherwise(inter / (union + 1e-6))
    if style == "floor":
        return inter / F.greatest(union, F.lit(1))
    return F.when(union <= 0, 0.0).otherwise(inter / F.greatest(union, F.lit(1)))


def boxes_close(a: Column, b: Column, gap) -> Column:
    """Closed boxes at most ``gap`` apart on both axes (gap 0: touching or overlapping)."""
    return (
        (_v(a, "x2") + gap >= _v(b, "x1")) & (_v(b, "x2") + gap >= _v(a, "x1"))
        & (_v(a, "y2") + gap >= _v(b, "y1")) & (_v(b, "y2") + gap >= _v(a, "y1"))
    )


def overlap_ratio(a: Column, b: Column) -> Column:
    return intersection(a, b) / F.greatest(F.lit(1), F.least(box_area(a), box_area(b)))


def x_overlap(a: Column, b: Column) -> Column:
    inter = F.greatest(F.least(_v(a, "x2"), _v(b, "x2")) - F.greatest(_v(a, "x1"), _v(b, "x1")), F.lit(0))
    return inter / F.greatest(F.lit(1), F.least(width(a), width(b)))


def y_overlap(a: Column, b: Column) -> Column:
    inter = F.greatest(F.least(_v(a, "y2"), _v(b, "y2")) - F.greatest(_v(a, "y1"), _v(b, "y1")), F.lit(0))
    return inter / F.greatest(F.lit(1), F.least(height(a), height(b)))
