"""The tile pyramid as a node table, and its JSON documents."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from . import lod

LEAF_PARENT_Z = lod.MIN_Z - 1
#: Latitude of the pyramid's edge.
EDGE_LAT = 85.0511287798


def children(nodes: DataFrame) -> DataFrame:
    """The four tiles below each (z, x, y), in row order."""
    four = F.array(*[F.struct((F.col("x") * 2 + dx).alias("x"), (F.col("y") * 2 + dy).alias("y")) for dy in (0, 1) for dx in (0, 1)])
    return nodes.select("root_z", "root_x", "root_y", F.posexplode(four).alias("child", "c"), (F.col("z") + 1).alias("z")).select("root_z", "root_x", "root_y", "z", "c.x", "c.y", "child")


def described(nodes: DataFrame, impl: str, mode: str = "add") -> DataFrame:
    """Region, geometric error, refinement and content of each node; what lies above the content zooms points to another document."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    content = z >= lod.MIN_Z
    inner = F.format_string(f"/{impl}/%d/%d/%d.glb", z, x, y)
    outer = F.format_string(f"/{impl}/sub/%d/%d/%d/tileset.json", z, x, y)
    is_root = z == F.col("root_z")
    refined = F.when(is_root, "ADD").when(content & (z < lod.MAX_Z), F.lit(lod.refine(lod.MIN_Z, mode)))
    return nodes.select(*nodes.columns, geo.region(z, x, y).alias("region"), lod.geometric_error(z).alias("geometric_error"), refined.alias("refine"), F.when(~is_root, F.when(content, inner).otherwise(outer)).alias("uri"))


def sub_tileset_nodes(roots: DataFrame, impl: str, mode: str = "add") -> DataFrame:
    """All nodes of the documents at (z, x, y): four links above z = 11, the content subtrees at z = 11."""
    first = roots.select(F.col("z").alias("root_z"), F.col("x").alias("root_x"), F.col("y").alias("root_y"), "z", "x", "y").withColumn("child", F.lit(0))
    out = level = first
    for k in range(lod.MAX_Z - LEAF_PARENT_Z):
        level = children(level if k == 0 else level.where(F.col("root_z") == LEAF_PARENT_Z))
        out = out.unionByName(level)
    return described(out, impl, mode)


def node_json(region: Column, error: Column, refine: Column, uri: Column, below: Column | None = None) -> Column:
    """A node struct; to_json leaves out its null fields."""
    fields = [F.struct(region.alias("region")).alias("boundingVolume"), error.alias("geometricError"), refine.alias("refine"), F.when(uri.isNotNull(), F.struct(uri.alias("uri"))).alias("content")]
    return F.struct(*fields, *([below.alias("children")] if below is not None else []))


def sub_tileset_json(nodes: DataFrame, copyright: str = "") -> DataFrame:
    """(root_z, root_x, root_y, json) of the documents, folded from the lowest level up."""
    root = ["root_z", "root_x", "root_y"]
    column = lambda c: F.col(c)
    below = None
    for k in range(lod.MAX_Z - LEAF_PARENT_Z, -1, -1):
        level = nodes.where(F.col("z") == F.col("root_z") + k)
        if below is not None:
            level = level.join(below, [*root, "x", "y"], "left")
        node = node_json(column("region"), column("geometric_error"), column("refine"), column("uri"), column("below") if below is not None else None)
        if k == 0:
            break
        rows = level.select(*root, F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), F.struct("child", node.alias("node")).alias("n"))
        below = rows.groupBy(*root, "x", "y").agg(F.transform(F.sort_array(F.collect_list("n")), lambda n: n["node"]).alias("below"))
    asset = F.struct(F.lit("1.1").alias("version"), *([F.lit(copyright).alias("copyright")] if copyright else []))
    return level.select(*root, F.to_json(F.struct(asset.alias("asset"), (F.col("geometric_error") * 2).alias("geometricError"), node.alias("root"))).alias("json"))


def root_tileset(impl: str, copyright: str = "") -> str:
    """The entry document: the whole world, refined by one link."""
    error = lod.EQUATOR_M / 30
    lon, lat = math.pi, math.radians(EDGE_LAT)
    root = {"boundingVolume": {"region": [-lon, -lat, lon, lat, 0, 1000]}, "geometricError": error, "refine": "ADD", "content": {"uri": f"/{impl}/sub/0/0/0/tileset.json"}}
    return json.dumps({"asset": {"version": "1.1"} | ({"copyright": copyright} if copyright else {}), "geometricError": error * 2, "root": root}, ensure_ascii=False)


def address_status(version: Column, impl: str, suffix: Column, z: Column, x: Column, y: Column, least: int, most: int, wanted: str = "glb") -> Column:
    """What asking for an output's address gives: 410 for another version, 404 for another suffix or zoom, 400 where numbers are not finite, else 200."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return (
        F.when(~version.eqNullSafe(F.lit(impl)), 410).when(~suffix.eqNullSafe(F.lit(wanted)), 404)
        .when(~(finite(z) & finite(x) & finite(y)), 400).when(~z.between(least, most), 404).otherwise(200)
    )


def check_address(z: float, x: float, y: float, least: int, most: int, version: str = "", impl: str = "", suffix: str = "glb", wanted: str = "glb") -> None:
    """Refuse an address for the reasons of :func:`address_status`."""
    if version != impl:
        raise LookupError("another version is served")
    if suffix != wanted:
        raise LookupError(f"only .{wanted} is served")
    if not all(math.isfinite(v) for v in (z, x, y)):
        raise ValueError("not a tile address")
    if not least <= z <= most:
        raise LookupError(f"only z={least}..{most} is served")


def cover(spark: SparkSession, west: float, south: float, east: float, north: float, z: int = 14) -> DataFrame:
    """Tiles (z, x, y) that cover a box, its edges included."""
    at = lambda lon, lat: geo.lonlat_to_tile(F.lit(z), F.lit(lon), F.lit(lat))
    a, b = at(west, north), at(east, south)
    rows = spark.range(1).select(a.alias("a"), b.alias("b")).select("b", "a", F.explode(F.sequence("a.x", "b.x")).alias("x"))
    return rows.select(F.lit(z).alias("z"), "x", F.explode(F.sequence("a.y", "b.y")).alias("y"))
