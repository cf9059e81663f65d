"""Orientation of layout elements (MA3, PF10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARGIN = 25.0  #: degrees off an axis that still count as upright
DIAGONAL = (25.0, 65.0)


def angle(points: Column) -> Column:
    """MA3: degrees in [0, 360) of the first side of a box of ``[x, y]`` points; null with fewer than two points, 0 for a point."""
    dx, dy = points[1][0] - points[0][0], points[1][1] - points[0][1]
    degrees = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))
    return F.when(F.size(points) >= 2, F.when((F.abs(dx) < 1e-6) & (F.abs(dy) < 1e-6), 0.0).otherwise(degrees))


def rotated(degrees: Column) -> Column:
    """MA3: more than ``MARGIN`` off every axis."""
    off = F.pmod(degrees, F.lit(90.0))
    return F.coalesce((off > MARGIN) & (off < 90 - MARGIN), F.lit(False))


def watermark(points: Column) -> Column:
    """PF10: rotated, and diagonal to the right, up or down."""
    a = angle(points)
    return rotated(a) & (a.between(*DIAGONAL) | (360 - a).between(*DIAGONAL))
