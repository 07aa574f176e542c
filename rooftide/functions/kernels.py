"""Arrow functions over whole columns of rings: list offsets and flat coordinates, no object per row or point."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import rings
from .geo import A

POLYGONS = "array<struct<outer:int,holes:array<int>,area:double,px:double,py:double>>"
LOCAL = "array<array<struct<e:double,n:double>>>"


def offsets(column: pa.Array) -> np.ndarray:
    """Where each row's elements begin in the values of a list column; rows of null have none."""
    return column.offsets.to_numpy().astype(np.int64)


def coordinates(points: pa.Array, *names: str) -> list[np.ndarray]:
    """Fields of points as doubles, null as NaN."""
    return [points.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]


def ahead(start: np.ndarray, end: np.ndarray, total: int) -> np.ndarray:
    """The place of each point's successor in its ring, the first one after the last."""
    out = np.arange(1, total + 1)
    some = end > start
    out[end[some] - 1] = start[some]
    return out


def sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of runs of values; 0 for empty ones."""
    out = np.zeros(len(start))
    some = end > start
    if some.any():
        # a run ends where the next one that isn't empty begins, or at the end of the values
        out[some] = np.add.reduceat(values[: int(end[some][-1])], start[some])
    return out


def measure_rings(column: pa.Array) -> pa.Array:
    """The polygons of each row of rings: places of the outer ring and of its holes, area and mean vertex in pixels."""
    row, inner = offsets(column), column.values
    at = offsets(inner)[int(row[0]) : int(row[-1]) + 1] if len(inner) else np.zeros(1, np.int64)
    row = row - row[0]
    x, y = coordinates(inner.values, "px", "py") if len(inner) else (np.empty(0), np.empty(0))
    x, y, at = x[at[0] : at[-1]], y[at[0] : at[-1]], at - at[0]
    start, end = at[:-1], at[1:]
    size = end - start
    last = np.maximum(end - 1, 0)
    closed = (size > 1) & (x[np.minimum(start, len(x) - 1)] == x[last]) & (y[np.minimum(start, len(x) - 1)] == y[last]) if len(x) else np.zeros(len(size), bool)
    after = ahead(start, end, len(x))
    area = sums(x * y[after] - x[after] * y, start, end) / 2
    points = size - closed
    valid = (points >= 3) & np.isfinite(area)
    opens = valid & (area > 0)
    opened = np.concatenate([[0], np.cumsum(opens)])
    of_row = np.repeat(np.arange(len(row) - 1), np.diff(row))
    polygon = opened[1:] - 1
    hole = valid & ~opens & (polygon >= opened[row[:-1]][of_row]) if len(of_row) else np.zeros(0, bool)
    outer = np.flatnonzero(opens)
    taken = np.bincount(polygon[hole], np.abs(area[hole]), len(outer))
    number = (np.arange(len(of_row)) - row[of_row]).astype(np.int32)
    holes = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(polygon[hole], minlength=len(outer)))]).astype(np.int32), pa.array(number[hole]))
    mean = [(sums(c, start[outer], end[outer]) if len(outer) == len(start) else sums(c, start, end)[outer]) for c in (x, y)]
    mean = [(m - np.where(closed[outer], c[last[outer]], 0)) / points[outer] for m, c in zip(mean, (x, y), strict=True)]
    fields = [pa.array(number[outer]), holes, pa.array(np.maximum(np.abs(area[outer]) - taken, 0.0)), pa.array(mean[0]), pa.array(mean[1])]
    found = pa.StructArray.from_arrays(fields, ["outer", "holes", "area", "px", "py"])
    return pa.ListArray.from_arrays(opened[row].astype(np.int32), found)


def place_rings(column: pa.Array, z: pa.Array, x: pa.Array, y: pa.Array, extent: pa.Array, lon: pa.Array, lat: pa.Array) -> pa.Array:
    """Pixel rings of a tile in metres east and north of an anchor."""
    row, inner = offsets(column), column.values
    at = offsets(inner)[int(row[0]) : int(row[-1]) + 1] if len(inner) else np.zeros(1, np.int64)
    px, py = coordinates(inner.values, "px", "py") if len(inner) else (np.empty(0), np.empty(0))
    px, py, at = px[at[0] : at[-1]], py[at[0] : at[-1]], at - at[0]
    row = row - row[0]
    number = lambda c: c.cast(pa.float64()).to_numpy(zero_copy_only=False)
    z, x, y, extent, lon, lat = map(number, (z, x, y, extent, lon, lat))
    n = 2.0**z
    degrees_north = lambda v: np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * v / n))))
    west, wide = x / n * 360 - 180, ((x + 1) / n * 360 - 180) - (x / n * 360 - 180)
    north, tall = degrees_north(y), degrees_north(y + 1) - degrees_north(y)
    east_scale = A * np.cos(np.radians(lat))
    of = np.repeat(np.arange(len(z)), at[row[1:]] - at[row[:-1]])
    e = np.radians(west[of] + wide[of] * (px / extent[of]) - lon[of]) * east_scale[of]
    m = np.radians(north[of] + tall[of] * (py / extent[of]) - lat[of]) * A
    placed = pa.StructArray.from_arrays([pa.array(e), pa.array(m)], ["e", "n"])
    return pa.ListArray.from_arrays(row.astype(np.int32), pa.ListArray.from_arrays(at.astype(np.int32), placed))


def measured(of: Column) -> Column:
    """array<struct<outer, holes, area, px, py>> of rings: a positive area opens a polygon, others are holes of the last one opened.

    ``outer`` and ``holes`` are places in the array of rings.  Closing points don't count, rings of fewer than three
    points or with null coordinates are skipped, holes before the first polygon are lost.
    """
    return arrow_udf(measure_rings, POLYGONS)(F.coalesce(of, F.array().cast("array<array<struct<px:int,py:int>>>")))


def polygons(of: Column) -> Column:
    """Rings as array<struct<outer, holes>> without closing points, as :func:`measured` groups them."""
    ring = lambda i: rings.strip_closure(F.get(of, i))
    return F.transform(measured(of), lambda m: F.struct(ring(m["outer"]).alias("outer"), F.transform(m["holes"], ring).alias("holes")))


def local_rings(of: Column, tile: Column, anchor: Column) -> Column:
    """Pixel rings of a tile struct<z,x,y,extent> in metres east and north of an anchor struct<lon,lat>."""
    return arrow_udf(place_rings, LOCAL)(F.coalesce(of, F.array().cast("array<array<struct<px:int,py:int>>>")), tile["z"], tile["x"], tile["y"], tile["extent"], anchor["lon"], anchor["lat"])
