"""Measured heights from landed JSON: catalogue, id lists, attribute batches; and the city presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, scalars

BATCH = 200
CATALOGUE = "struct<cities:array<struct<files:struct<bldg:array<struct<url:string>>>>>>"
ATTRIBUTES = "struct<`bldg:measuredHeight`:double,_bbox:struct<center:struct<lng:double,lat:double>>>"
NO_DATA = -9999.0
# Calibration areas as name, city code, west, south, east, north, note.
CITIES = [
    ("chiyoda", "13101", 139.760, 35.675, 139.775, 35.687, "high-rise office core"),
    ("setagaya", "13112", 139.665, 35.640, 139.680, 35.650, "dense low-rise residential"),
    ("nishi-yokohama", "14100", 139.625, 35.450, 139.640, 35.465, "tower apartments + warehouses"),
    ("tsukuba", "08220", 140.105, 36.075, 140.120, 36.090, "planned low/mid-rise + research"),
    ("iiyama", "20213", 138.360, 36.845, 138.380, 36.860, "small mountain town, low-rise"),
]


def cities(spark: SparkSession, name: str | None = None) -> DataFrame:
    """The presets, or the one of that exact name."""
    table = spark.createDataFrame(CITIES, "name string, city_code string, west double, south double, east double, north double, note string")
    return table if name is None else table.where(F.col("name") == name)


def city_lines(table: DataFrame) -> DataFrame:
    return table.select(F.format_string("%-16s %s  [%.3f,%.3f,%.3f,%.3f]  %s", "name", "city_code", "west", "south", "east", "north", "note").alias("line"))


def file_urls(catalogues: DataFrame, column: str = "json") -> DataFrame:
    """Every building file of every city of the catalogues."""
    parsed = catalogues.select(F.from_json(column, CATALOGUE).alias("c"))
    return parsed.select(F.explode("c.cities").alias("city")).select(F.explode("city.files.bldg.url").alias("url")).where(F.col("url").isNotNull())


def prune(urls: DataFrame, box: dict[str, float | Column]) -> DataFrame:
    """Files whose grid cell meets the box; names without a cell stay."""
    cell = geo.mesh_code_bbox(geo.mesh_code_of_url(F.col("url")))
    return urls.where(F.coalesce(geo.intersects(cell, box), F.lit(True)))


def feature_ids(lists: DataFrame, column: str = "json") -> DataFrame:
    """String entries of featureIds."""
    ids = F.from_json(column, "struct<featureIds:array<variant>>")["featureIds"]
    texts = F.transform(ids, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return lists.select(*[c for c in lists.columns if c != column], F.explode(F.filter(texts, lambda v: v.isNotNull())).alias("feature_id"))


def batches(ids: DataFrame, per: str = "url") -> DataFrame:
    """(per, batch, ids): requests of 200 ids."""
    n = F.row_number().over(Window.partitionBy(per).orderBy("feature_id"))
    return ids.withColumn("batch", F.floor((n - 1) / BATCH).cast("int")).groupBy(per, "batch").agg(F.sort_array(F.collect_list("feature_id")).alias("ids"))


def valid_height(h: Column) -> Column:
    return (h > 0) & ~F.isnan(h) & (F.abs(h - NO_DATA) >= 0.5)


def records(landed: DataFrame, column: str = "json") -> DataFrame:
    """(lon, lat, measured_height_m) of attribute batches (JSON arrays); records without height or centre are dropped."""
    rows = landed.select(F.explode(F.from_json(column, f"array<{ATTRIBUTES}>")).alias("r"))
    flat = rows.select(F.col("r._bbox.center.lng").alias("lon"), F.col("r._bbox.center.lat").alias("lat"), F.col("r.`bldg:measuredHeight`").alias("h"))
    return flat.where(valid_height(F.col("h")) & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("lon", "lat", F.col("h").cast("float").alias("measured_height_m"))


def composed(catalogues: DataFrame, lists: DataFrame, landed: DataFrame, box: dict[str, float]) -> DataFrame:
    """(lon, lat, measured_height_m) within a box, from landed JSON: the catalogue's files that meet it, their ids' records.

    ``catalogues`` has ``json``; ``lists`` has ``url`` and ``json``; ``landed`` has ``url``, ``batch`` and ``json``, the
    answers to :func:`batches`.  Only answers to batches of files that meet the box are read.
    """
    urls = prune(file_urls(catalogues), box).distinct()
    asked = batches(feature_ids(lists.join(urls, "url", "left_semi")))
    return in_box(records(landed.join(asked.select("url", "batch"), ["url", "batch"], "left_semi")).withColumnRenamed("measured_height_m", "h"), box).withColumnRenamed("h", "measured_height_m")


def in_box(truth: DataFrame, box: dict[str, float]) -> DataFrame:
    return truth.where(geo.contains(box, F.col("lon"), F.col("lat")))


def csv_lines(truth: DataFrame) -> DataFrame:
    return truth.select(F.concat_ws(",", scalars.fixed(F.col("lon"), 7), scalars.fixed(F.col("lat"), 7), scalars.fixed(F.col("measured_height_m").cast("double"), 2)).alias("line"))


def write_csv(truth: DataFrame, path: str) -> None:
    """Text lines under a header, one file per partition."""
    csv_lines(truth).select(F.split("line", ",").alias("v")).select(*[F.col("v")[i].alias(c) for i, c in enumerate(("lon", "lat", "measured_height_m"))]).write.option("header", True).csv(path)
