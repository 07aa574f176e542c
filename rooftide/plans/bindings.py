"""The driver's tables as building data: line items are footprint fragments, orders are measured heights."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.config import HeightConfig
from ..operators import buildings

Z, X0, Y0, EXTENT = 14, 14552, 6451, 4096
#: Total order of the fragments of a feature.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
#: Columns that features are made of.
LINE = ("l_orderkey", *ORDER)
RASTER = 8
#: Bytes of a table that a core may scan before its rows are dealt out, and parts that are sent to every executor at once.
SPLIT, FEW = 4 << 20, 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rows over all cores where their table comes in fewer files than there are cores and is small; Spark splits larger files itself."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(table.inputFiles()) >= cores or int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * SPLIT:
        return df
    return df.repartition(cores)


def placed(rows: DataFrame) -> DataFrame:
    """Rows of line items with tile, corner and sides of their rectangle."""
    tile = F.expr("if(l_orderkey % 1000 < 5, 100 + l_orderkey % 1000, ((l_orderkey % 500) * (l_orderkey % 500)) div 2500) + if(l_linenumber = 2 and l_orderkey % 7 = 0, 1, 0)")
    side = lambda n: F.expr(f"cast(if(l_orderkey % 97 = 1, 3, ({n}) * if(l_orderkey % 50 = 0, 5, 1)) as int)")
    px, py = F.expr("cast((l_partkey * 37) % 3800 as int)"), F.expr("cast((l_suppkey * 101) % 3800 as int)")
    return rows.withColumns({"tile": tile, "px0": px, "py0": py, "w": side("4 + cast(l_quantity as int)"), "h": side("4 + 8 * l_linenumber")})


def tile_x() -> Column:
    return (X0 + F.col("tile") % 11).cast("int")


def tile_y() -> Column:
    return F.expr(f"cast({Y0} + tile div 11 as int)")


def with_sizes(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Line items with ``p_size`` of their part.  Parts go to every executor if they are few, so that line items stay where they are."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    few = parts.count() <= FEW  # from the files' footers
    return lines.join(F.broadcast(parts) if few else parts, F.col("l_partkey") == F.col("p_partkey"), "left")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle per line item; parts give class and subtype."""
    lines = read(spark, sf_dir, "lineitem").select(*LINE)
    rows = dealt(placed(with_sizes(spark, sf_dir, lines)), lines)
    point = lambda x, y: F.struct(x.alias("px"), y.alias("py"))
    a, b, c, d = F.col("px0"), F.col("py0"), F.col("px0") + F.col("w"), F.col("py0") + F.col("h")
    return rows.select(
        F.col("l_orderkey").alias("feature_id"), F.lit(Z).alias("z"), tile_x().alias("x"), tile_y().alias("y"),
        F.lit(EXTENT).alias("extent"), "tile", "px0", "py0", "w", "h",
        F.array(F.array(point(a, b), point(c, b), point(c, d), point(a, d), point(a, b))).alias("rings"),
        F.col("tile").alias("source_idx"), F.col("l_linenumber").alias("feat_idx"),
        F.when(F.col("l_discount") >= 0.09, 3 + F.col("l_extendedprice") / 1000).alias("height"),
        F.when(F.col("l_tax") >= 0.07, 1 + F.col("l_linenumber")).cast("bigint").alias("num_floors"),
        F.expr("case p_size % 10 when 0 then 'house' when 1 then 'apartments' when 2 then 'office' when 3 then 'unknown_class' end").alias("class"),
        F.expr("case p_size % 3 when 0 then 'residential' when 1 then 'unknown_sub' end").alias("subtype"),
        ((F.col("l_quantity") == 13) & (F.col("l_tax") < 0.01)).alias("is_underground"), *ORDER,
    )


def extracted(spark: SparkSession, sf_dir: str, cfg: HeightConfig | None = None, **more: object) -> DataFrame:
    return buildings.extract_buildings(features(spark, sf_dir), cfg, ORDER, **more)


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_id, ring) of the features above ground in global pixels, north up; those without area are no building's."""
    rows = features(spark, sf_dir).where(F.coalesce(~F.col("is_underground"), F.lit(True)) & (F.col("w") > 0) & (F.col("h") > 0))
    x0, y0 = F.col("x").cast("double") * EXTENT + F.col("px0"), F.col("y").cast("double") * EXTENT + F.col("py0")
    point = lambda x, y: F.struct(x.alias("lon"), (-y).alias("lat"))
    x1, y1 = x0 + F.col("w"), y0 + F.col("h")
    return rows.select("feature_id", F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)).alias("ring"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(truth_id, lon, lat, truth_m): an order's point is the middle of its first fragment, moved away for each fourth order."""
    # what stands behind the first four of ORDER changes neither tile nor rectangle
    lines = read(spark, sf_dir, "lineitem").where(F.coalesce(~((F.col("l_quantity") == 13) & (F.col("l_tax") < 0.01)), F.lit(True))).select("l_orderkey", *ORDER[:4])
    first = placed(lines.repartition("l_orderkey").groupBy("l_orderkey").agg(F.min(F.struct(*ORDER[:4])).alias("p")).select("l_orderkey", "p.*"))
    first = first.select(F.col("l_orderkey").alias("feature_id"), tile_x().alias("x"), tile_y().alias("y"), "px0", "py0", "w", "h")
    at = lambda axis, corner, side: F.col(axis).cast("double") * EXTENT + F.col(corner) + F.col(side) / 2
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    joined = orders.join(first, F.col("o_orderkey") == F.col("feature_id"))
    moved = F.when(F.col("o_orderkey") % 4 == 0, F.lit(5000.0)).otherwise(F.lit(0.0))
    return joined.select(F.col("o_orderkey").alias("truth_id"), (at("x", "px0", "w") + moved).alias("lon"), (-at("y", "py0", "h")).alias("lat"), (3 + F.col("o_totalprice") / 10000).cast("float").alias("truth_m"))


def truth_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same points in degrees, moved by a part of a pixel so that none lies on an outline."""
    gx, gy = F.col("lon") + 0.123, -F.col("lat") + 0.217
    tile_y = F.floor(gy / EXTENT)
    north, south = geo.lat_of(F.lit(Z), tile_y), geo.lat_of(F.lit(Z), tile_y + 1)
    return truth(spark, sf_dir).select("truth_id", geo.lon_of(F.lit(Z), gx / EXTENT).alias("lon"), (north + (south - north) * (gy / EXTENT - tile_y)).alias("lat"), "truth_m")


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of some two by two tiles for each nation; neighbours overlap."""
    k = F.col("n_nationkey")
    x, y = X0 + k % 5 * 2 + F.lit(0.3), Y0 + F.floor(k / 5) * 2 + F.lit(0.2)
    lon, lat = (lambda v: geo.lon_of(F.lit(Z), v)), (lambda v: geo.lat_of(F.lit(Z), v))
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), lon(x).alias("west"), lat(y + 1.9).alias("south"), lon(x + 2.3).alias("east"), lat(y).alias("north"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_id, ring) in global pixels, by line number a triangle, an angle of two arms, or a rectangle."""
    rows = features(spark, sf_dir).where(F.coalesce(~F.col("is_underground"), F.lit(True)))
    x0, y0 = F.col("x").cast("double") * EXTENT + F.col("px0"), F.col("y").cast("double") * EXTENT + F.col("py0")
    x1, y1, xm, ym = x0 + F.col("w"), y0 + F.col("h"), x0 + F.col("w") / 2, y0 + F.col("h") / 2
    ring = lambda *points: F.array(*(F.struct(x.alias("lon"), y.alias("lat")) for x, y in points))
    kind = F.col("l_linenumber") % 3
    found = F.when(kind == 0, ring((x0, y0), (x1, y0), (x0, y1))).when(kind == 1, ring((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1))).otherwise(ring((x0, y0), (x1, y0), (x1, y1), (x0, y1)))
    return rows.select("feature_id", found.alias("ring"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(truth_id, lon, lat) in global pixels: a point at some part of each line item's box, by its number."""
    rows = features(spark, sf_dir).where("l_linenumber <= 3")
    part = lambda axis, corner, side, k: F.col(axis).cast("double") * EXTENT + F.col(corner) + F.col(side) * k + 0.123
    across, down = F.expr("(feature_id % 10) / 10d"), F.expr("(feature_id % 7) / 7d")
    name = F.col("feature_id") * 8 + F.col("l_linenumber")
    return rows.select(name.alias("truth_id"), part("x", "px0", "w", across).alias("lon"), part("y", "py0", "h", down).alias("lat"))


def raster_value(x: Column, y: Column, column: Column, row: Column) -> Column:
    """Height in whole metres of a pixel of the synthetic terrain."""
    return (x * 31 + y * 17 + row * 7 + column * 3) % 200


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 raster of coloured pixels for each tile whose number isn't divisible by 5."""
    tiles = features(spark, sf_dir).where(F.col("tile") % 5 != 0).select("z", "x", "y").distinct()
    cells = F.sequence(F.lit(0), F.lit(RASTER * RASTER - 1))

    def pixel(k: Column) -> Column:
        v = raster_value(F.col("x"), F.col("y"), k % RASTER, F.floor(k / RASTER)) + 32768
        return F.struct(F.floor(v / 256).alias("r"), (v % 256).alias("g"), F.lit(0).alias("b"))

    return tiles.select("z", "x", "y", F.lit(RASTER).alias("width"), F.lit(RASTER).alias("height"), F.transform(cells, pixel).alias("rgb"))


def _varint(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes(out + bytes([v]))


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _typed(v: object) -> bytes:
    if isinstance(v, bool):
        return _varint(7 << 3) + _varint(int(v))
    if isinstance(v, str):
        return _field(1, v.encode())
    if isinstance(v, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _varint(4 << 3) + _varint(v & (1 << 64) - 1)


def encode_tile(rows: list[dict], extent: int = EXTENT, layer: str = "building") -> bytes:
    """A vector tile of features with ``id``, ``rings`` and other keys as attributes."""
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    features = []
    for row in rows:
        tags = [n for k, v in row.items() if k not in ("id", "rings") and v is not None for n in (keys.setdefault(k, len(keys)), values.setdefault((type(v), v), len(values)))]
        commands, x, y = [], 0, 0
        for ring in row["rings"]:
            points = ring[:-1] if ring[0] == ring[-1] else ring
            for i, (px, py) in enumerate(points):
                if i < 2:
                    commands.append(1 << 3 | 1 if i == 0 else (len(points) - 1) << 3 | 2)
                commands += [((d := px - x) << 1) ^ (d >> 31), ((d := py - y) << 1) ^ (d >> 31)]
                x, y = px, py
            commands.append(1 << 3 | 7)
        head = _varint(1 << 3) + _varint(row["id"]) if row.get("id") is not None else b""
        features.append(head + _field(2, b"".join(map(_varint, tags))) + _varint(3 << 3) + _varint(3) + _field(4, b"".join(map(_varint, commands))))
    body = _field(1, layer.encode()) + b"".join(_field(2, f) for f in features) + b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _typed(v)) for _, v in values) + _varint(5 << 3) + _varint(extent) + _varint(15 << 3) + _varint(2)
    return _field(3, body)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, x, y, content): the features of each tile as a vector tile.  A tile's features are its own and bounded by it."""
    import pandas as pd

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(ORDER[:7]))
        listed = [
            {"id": r.feature_id, "rings": [[(r.px0, r.py0), (r.px0 + r.w, r.py0), (r.px0 + r.w, r.py0 + r.h), (r.px0, r.py0 + r.h)]], "height": None if pd.isna(r.height) else float(r.height), "num_floors": None if pd.isna(r.num_floors) else int(r.num_floors), "class": r.kind, "subtype": r.subtype, "is_underground": bool(r.is_underground)}
            for r in rows.itertuples()
        ]
        return pd.DataFrame({"z": [key[0]], "x": [key[1]], "y": [key[2]], "content": [encode_tile(listed)]})

    rows = features(spark, sf_dir).withColumnRenamed("class", "kind").drop("rings", "l_shipdate")
    return rows.groupBy("z", "x", "y").applyInPandas(one, "z int, x int, y int, content binary")
