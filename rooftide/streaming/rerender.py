"""Incremental rendering of a stream of source tiles.

The stream is a folder of Parquet files of (z, x, y, content).  Each micro-batch
hashes its tiles, keeps those whose output is not in the manifest, decodes and
resolves them, and writes the building rows with their tile's hash, then the
manifest.  Both are written to partitions of the batch's number, which a batch
that runs again replaces, and one whose manifest is there already finds nothing
to do: each output is there once, and no state and no watermark is needed.  A
tile whose content has changed leaves its old rows in their batch;
:func:`current` reads the latest ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import TILE, render_tiles, tile_buildings
from ..functions.config import HeightConfig
from ..operators import lod, manifest
from ..sources import outputs
from ..sources.vector_tiles import read_tiles

TILES = "z int, x int, y int, content binary"


def hashes(tiles: DataFrame, area: tuple[float, float]) -> DataFrame:
    """Content hashes of tiles that are their own and only source."""
    sources = tiles.select(F.col("z").alias("out_z"), F.col("x").alias("out_x"), F.col("y").alias("out_y"), "z", "x", "y", "content", F.lit(0).alias("position"))
    outputs = tiles.select("z", "x", "y", F.lit(None).cast("binary").alias("terrain"))
    return manifest.content_hash(outputs, sources, area)


def render(tiles: DataFrame, cfg: HeightConfig | None = None, z: int = lod.MAX_Z) -> DataFrame:
    """Buildings of each tile by itself: density of the tile, height by the first fragment, footprints of the zoom."""
    return tile_buildings(read_tiles(tiles), cfg, zoom=z)


def known(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, empty before the first write."""
    schema = "hash string, impl string"
    return spark.read.schema(f"z int, x int, y int, {schema}").parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def current(spark: SparkSession, out: str, impl: str) -> DataFrame:
    """The buildings of each tile's latest content."""
    latest = spark.read.parquet(f"{out}/manifest").where(F.col("impl") == impl).groupBy(*TILE).agg(F.max(F.struct("batch", "hash")).alias("m")).select(*TILE, "m.batch", "m.hash")
    return spark.read.parquet(f"{out}/buildings").where(F.col("impl") == impl).join(latest, [*TILE, "batch", "hash"], "left_semi")


def exists(spark: SparkSession, path: str) -> bool:
    """Asks the path's own file system, wherever it is."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def start(spark: SparkSession, source: str, out: str, checkpoint: str, impl: str, cfg: HeightConfig | None = None, once: bool = True, glb: bool = False) -> StreamingQuery:
    """Buildings go to ``out``/buildings, hashes to ``out``/manifest; with ``glb`` each tile's glb goes to ``out``/tiles as well."""

    def batch(tiles: DataFrame, number: int) -> None:
        tiles = tiles.persist()
        todo = manifest.pending(hashes(tiles, lod.area_range(lod.MAX_Z)), known(spark, f"{out}/manifest"), impl).persist()
        rows = render(tiles.join(todo.select("z", "x", "y"), list(TILE), "left_semi"), cfg).join(todo.select(*TILE, "hash"), list(TILE))
        if glb:
            drawn = render_tiles(read_tiles(tiles.join(todo.select(*TILE), list(TILE), "left_semi")), cfg=cfg).select("tile.*", "glb")
            outputs.write(drawn.join(todo.select(*TILE, "hash"), list(TILE)), f"{out}/tiles", impl)
        for name, found in (("buildings", rows.select(*TILE, "feature_id", "footprint_m2", "height_m", "height_method", "lon", "lat", "hash")), ("manifest", todo.select(*TILE, "hash"))):
            placed = found.withColumn("impl", F.lit(impl)).withColumn("batch", F.lit(number).cast("long"))
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("impl", "batch").parquet(f"{out}/{name}")
        todo.unpersist()
        tiles.unpersist()

    spark.dataSource.register(outputs.TileOutputs)  # batches run in copies of this session, which know what it knows
    stream = spark.readStream.schema(TILES).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
