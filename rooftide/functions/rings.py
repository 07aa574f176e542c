"""Rings as array<struct<px, py>> or array<struct<lon, lat>>, handled with higher-order functions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotated(ring: Column) -> Column:
    """Each point's successor, the first one after the last."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))


def strip_closure(ring: Column) -> Column:
    """The ring without its repeated end."""
    return F.when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def signed_area(ring: Column, x: str = "px", y: str = "py") -> Column:
    """Shoelace area of a ring with or without its repeated end, in units of its coordinates."""
    cross = F.zip_with(ring, rotated(ring), lambda a, b: a[x].cast("double") * b[y] - b[x].cast("double") * a[y])
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) * 0.5


def bounds(ring: Column, x: str = "lon", y: str = "lat") -> Column:
    """Least and greatest coordinates; null for an empty ring."""
    xs, ys = F.transform(ring, lambda p: p[x]), F.transform(ring, lambda p: p[y])
    return F.when(F.size(ring) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def box_ring(ring: Column) -> Column:
    """The ring's bounding rectangle in pixels as a ring of four points, without holes."""
    b = bounds(ring, "px", "py")
    point = lambda x, y: F.struct(b[x].alias("px"), b[y].alias("py"))
    return F.when(b.isNotNull(), F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1")))


def point_in_ring(ring: Column, px: Column, py: Column, x: str = "lon", y: str = "lat") -> Column:
    """Even-odd ray casting; false for fewer than three points."""

    def crosses(a: Column, b: Column) -> Column:
        straddles = (a[y] > py) != (b[y] > py)
        rise = b[y] - a[y]
        at = (b[x] - a[x]) * (py - a[y]) / F.when(F.abs(rise) < 1e-30, F.lit(1e-30)).otherwise(rise) + a[x]
        return F.when(straddles, px < at).otherwise(F.lit(False))

    inside = F.aggregate(F.zip_with(ring, rotated(ring), crosses), F.lit(False), lambda s, c: s != c)
    return F.when(F.size(ring) >= 3, inside).otherwise(F.lit(False))
