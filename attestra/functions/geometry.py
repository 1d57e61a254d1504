"""Boxes (left, top, right, bottom) as plain columns: arithmetic that stays in generated code and in join conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns l, t, r, b with a prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in "ltrb")


def area(a: Box) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Box, b: Box) -> Column:
    """GEO-03: intersection over union; 0 for empty boxes."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap(a: Box, b: Box) -> Column:
    """GEO-04, GEO-05: the share of a that lies in b; 0 for an empty a."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def normalised(c: Column, extent: Column) -> Column:
    """GEO-01: a coordinate in 0 to 1; one that is there already stays."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c <= 1.0, c).otherwise(c / extent)))


def degenerate(a: Box) -> Column:
    """GEO-08: whether a box has no width or no height."""
    return ((a[2] - a[0]) <= 1e-4) | ((a[3] - a[1]) <= 1e-4)


def centre_inside(a: Box, b: Box) -> Column:
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return (x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3])


def both_boxes(a: Box, width: Column, height: Column) -> Column:
    """GEO-02: struct<l, t, r, b, pl, pt, pr, pb>: a box in shares of the page and in pixels, whichever it came in; inverted corners are swapped.

    Up to 1.05 all coordinates are shares. Without a page size shares are of 1000 by 1000, pixels of at least 595 by 842.
    """
    l, t, r, b = F.least(a[0], a[2]), F.least(a[1], a[3]), F.greatest(a[0], a[2]), F.greatest(a[1], a[3])  # noqa: E741
    shares = (r <= 1.05) & (b <= 1.05)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    near = lambda c, n: F.floor(c * 10**n + 0.5) / 10**n
    pw = F.when(width > 0, width).otherwise(F.when(shares, 1000.0).otherwise(F.greatest(r, F.lit(595.0))))
    ph = F.when(height > 0, height).otherwise(F.when(shares, 1000.0).otherwise(F.greatest(b, F.lit(842.0))))
    out = []
    for name, c, size in (("l", l, pw), ("t", t, ph), ("r", r, pw), ("b", b, ph)):
        out += [F.when(shares, unit(c)).otherwise(near(unit(c / size), 4)).alias(name), F.when(shares, near(unit(c) * size, 1)).otherwise(near(c, 1)).alias(f"p{name}")]
    return F.struct(*out)


def containment(predicted: Box, truth: Box) -> Column:
    """GEO-05: the share of a true box that a predicted one covers; 0 for an empty true box."""
    return F.when(area(truth) > 0, intersection(predicted, truth) / area(truth)).otherwise(0.0)


def corners(a: Box) -> Column:
    """GEO-07: the four corners of a box, from the top left one clockwise, as [x, y] pairs."""
    return F.array(F.array(a[0], a[1]), F.array(a[2], a[1]), F.array(a[2], a[3]), F.array(a[0], a[3]))


def scaled_corners(a: Box, width: Column, height: Column) -> Column:
    """GEO-07: the corners in shares of the page, each from 0 to 1, to four places."""
    unit = lambda c, size: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / size)) * 10000 + 0.5) / 10000
    return F.transform(corners(a), lambda p: F.array(unit(p[0], width), unit(p[1], height)))


def from_bottom(a: Box, height: Column) -> Box:
    """GEO-10: a box with its origin at the bottom left, from the top left; top and bottom in order."""
    return a[0], F.least(height - a[1], height - a[3]), a[2], F.greatest(height - a[1], height - a[3])
