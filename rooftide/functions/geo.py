"""Geodesy on columns: tile pyramid, WGS84, local east-north-up frames.  Angles are degrees unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 semi-major axis and flattening.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
B = A * (1 - FLATTENING)
EP2 = (A * A - B * B) / (B * B)


def lon_of(z: Column, x: Column) -> Column:
    """Western edge of tile column x."""
    return x.cast("double") / F.pow(F.lit(2.0), z) * 360.0 - 180.0


def lat_of(z: Column, y: Column) -> Column:
    """Northern edge of tile row y."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - y.cast("double") * 2.0 / F.pow(F.lit(2.0), z)))))


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    return F.struct(lon_of(z, x).alias("west"), lat_of(z, y + 1).alias("south"), lon_of(z, x + 1).alias("east"), lat_of(z, y).alias("north"))


def tile_center(z: Column, x: Column, y: Column) -> Column:
    """Middle of the bounds in degrees."""
    return F.struct(((lon_of(z, x) + lon_of(z, x + 1)) / 2).alias("lon"), ((lat_of(z, y) + lat_of(z, y + 1)) / 2).alias("lat"))


def lon_to_x(z: Column, lon: Column) -> Column:
    """Fractional tile column, not clamped."""
    return (lon + 180.0) / 360.0 * F.pow(F.lit(2.0), z)


def lat_to_y(z: Column, lat: Column) -> Column:
    """Fractional tile row, not clamped."""
    return (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * F.pow(F.lit(2.0), z)


def lonlat_to_tile(z: Column, lon: Column, lat: Column) -> Column:
    """Tile that holds a point, clamped to the pyramid."""
    top = F.pow(F.lit(2.0), z) - 1
    clamp = lambda v: F.least(F.greatest(F.floor(v), F.lit(0.0)), top).cast("int")
    return F.struct(clamp(lon_to_x(z, lon)).alias("x"), clamp(lat_to_y(z, lat)).alias("y"))


def wgs84_to_ecef(lon: Column, lat: Column, height: Column) -> Column:
    lam, phi = F.radians(lon), F.radians(lat)
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(phi) * F.sin(phi))
    return F.struct(((n + height) * F.cos(phi) * F.cos(lam)).alias("x"), ((n + height) * F.cos(phi) * F.sin(lam)).alias("y"), ((n * (1 - E2) + height) * F.sin(phi)).alias("z"))


def ecef_to_wgs84(x: Column, y: Column, z: Column) -> Column:
    """Bowring's closed form."""
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, p * B)
    phi = F.atan2(z + F.lit(EP2 * B) * F.pow(F.sin(theta), F.lit(3)), p - F.lit(E2 * A) * F.pow(F.cos(theta), F.lit(3)))
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(phi) * F.sin(phi))
    return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(phi).alias("lat"), (p / F.cos(phi) - n).alias("height"))


def enu_to_ecef(lon: Column, lat: Column, height: Column) -> Column:
    """Column-major 4x4 affine from local east-north-up metres to ECEF."""
    lam, phi = F.radians(lon), F.radians(lat)
    o = wgs84_to_ecef(lon, lat, height)
    zero, one = F.lit(0.0), F.lit(1.0)
    east = [-F.sin(lam), F.cos(lam), zero]
    north = [-F.sin(phi) * F.cos(lam), -F.sin(phi) * F.sin(lam), F.cos(phi)]
    up = [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]
    return F.array(*east, zero, *north, zero, *up, zero, o["x"], o["y"], o["z"], one)


def y_up(matrix: Column) -> Column:
    """The same placement for y-up meshes in a y-up world: columns E, U, -N, origin; then rows x, z, -y."""
    e = lambda c, r: F.get(matrix, F.lit(4 * c + r))
    columns = [[e(0, r) for r in range(4)], [e(2, r) for r in range(4)], [-e(1, r) for r in range(3)] + [e(1, 3)], [e(3, r) for r in range(4)]]
    return F.array(*[x for c in columns for x in (c[0], c[2], -c[1], c[3])])


def pixel_to_lonlat(z: Column, x: Column, y: Column, extent: Column, px: Column, py: Column) -> Column:
    """Position of a tile pixel; latitude is linear between the tile's edges."""
    fx, fy = px.cast("double") / extent, py.cast("double") / extent
    west, north = lon_of(z, x), lat_of(z, y)
    return F.struct((west + (lon_of(z, x + 1) - west) * fx).alias("lon"), (north + (lat_of(z, y + 1) - north) * fy).alias("lat"))


def lonlat_to_enu(lon: Column, lat: Column, anchor_lon: Column, anchor_lat: Column) -> Column:
    """Equirectangular metres east and north of an anchor."""
    return F.struct((F.radians(lon - anchor_lon) * A * F.cos(F.radians(anchor_lat))).alias("e"), (F.radians(lat - anchor_lat) * A).alias("n"))


def pixel_scale(z: Column, x: Column, y: Column, extent: Column) -> tuple[Column, Column]:
    """Metres east and south of one pixel, anchored at the tile's centre."""
    middle = (lat_of(z, y) + lat_of(z, y + 1)) / 2
    east = F.radians(lon_of(z, x + 1) - lon_of(z, x)) / extent * A * F.cos(F.radians(middle))
    south = F.radians(lat_of(z, y) - lat_of(z, y + 1)) / extent * A
    return east, south


def region(z: Column, x: Column, y: Column, low: float = 0.0, high: float = 1000.0) -> Column:
    """West, south, east, north in radians, and a height range in metres."""
    return F.array(F.radians(lon_of(z, x)), F.radians(lat_of(z, y + 1)), F.radians(lon_of(z, x + 1)), F.radians(lat_of(z, y)), F.lit(low), F.lit(high))


def mesh_code_bbox(code: Column) -> Column:
    """Bounds of an 8-digit third-order grid code; null for anything else."""
    digit = lambda a, n: F.try_to_number(F.substring(code, a, n), F.lit("9" * n)).cast("int")
    south = digit(1, 2) / 1.5 + digit(5, 1) * 5 / 60 + digit(7, 1) * 30 / 3600
    west = digit(3, 2) + 100 + digit(6, 1) * 7.5 / 60 + digit(8, 1) * 45 / 3600
    box = F.struct(west.cast("double").alias("west"), south.cast("double").alias("south"), (west + 45 / 3600).cast("double").alias("east"), (south + 30 / 3600).cast("double").alias("north"))
    return F.when(code.rlike("^[0-9]{8}$"), box)


def mesh_code_of_url(url: Column) -> Column:
    """Last path segment up to its first underscore."""
    return F.split_part(F.element_at(F.split(url, "/"), -1), F.lit("_"), F.lit(1))


def contains(box: dict[str, float | Column], lon: Column, lat: Column) -> Column:
    """Point in box, all edges included."""
    return lon.between(box["west"], box["east"]) & lat.between(box["south"], box["north"])


def intersects(a: Column, b: dict[str, float | Column]) -> Column:
    """Box struct against a box; touching counts."""
    return (a["west"] <= b["east"]) & (a["east"] >= b["west"]) & (a["south"] <= b["north"]) & (a["north"] >= b["south"])
