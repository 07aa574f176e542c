"""The registered queries over the driver's tables, each beside its DuckDB twin."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import engine
from ..functions import geo, kernels, scalars
from ..functions.config import HeightConfig
from ..functions.session import shared_folder
from ..operators import cities as city_table
from ..operators import buildings, glb, lod, manifest, mesh, metrics, raster, spatial, tileset
from ..operators import cities as city_table
from ..sources import outputs, truth, vector_tiles
from . import bindings as data
from .oracles import CITIES, FEATURES, MERGED, ORDER, TRUTH, buildings_sql, cascade_sql, city_sql, level_sql, pairs_sql, stats_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CFG = HeightConfig()
#: A second parameter set: taller floors, offices and hotels.
TALL = HeightConfig(meters_per_floor=3.5, class_height_m=CFG.class_height_m | {"office": 60.0, "commercial": 60.0, "hotel": 45.0})
IMPL = "v1-add"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(c: str | Column, n: int, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), n).alias(name or c)


def tiles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.features(spark, sf_dir).select("z", "x", "y", "tile").distinct()


@query(f"WITH {FEATURES}, {MERGED}, {buildings_sql(CFG)} SELECT feature_id, round(footprint_m2::DOUBLE, 2) AS footprint_m2, round(height_m::DOUBLE, 3) AS height_m, height_method FROM b")
def height_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every building with its footprint, height and the step that gave it."""
    return data.extracted(spark, sf_dir).select("feature_id", rounded("footprint_m2", 2), rounded("height_m", 3), "height_method")


@query(f"WITH {FEATURES}, {MERGED}, {buildings_sql(CFG)} SELECT height_method, count(*) AS n, round(avg(height_m::DOUBLE), 4) AS avg_height FROM b GROUP BY height_method")
def buildings_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and mean height of buildings by cascade step."""
    return data.extracted(spark, sf_dir).groupBy("height_method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("height_m").cast("double")), 4).alias("avg_height"))


@query(f"WITH {FEATURES} SELECT tile, count(*) AS n_features, sum(CASE WHEN coalesce(NOT is_underground, true) THEN 1 ELSE 0 END)::BIGINT AS n_kept FROM f GROUP BY tile")
def underground_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each tile, and those above ground."""
    rows = buildings.complete(data.features(spark, sf_dir))
    return rows.groupBy("tile").agg(F.count(F.lit(1)).alias("n_features"), F.sum(buildings.above_ground().cast("long")).alias("n_kept"))


@query(f"WITH {FEATURES}, {MERGED} SELECT CASE WHEN footprint_m2 >= 10000 THEN 12 WHEN footprint_m2 >= 2000 THEN 13 WHEN footprint_m2 >= 5 THEN 14 END AS zoom, count(*) AS n, round(sum(footprint_m2::DOUBLE), 1) AS total_m2 FROM m GROUP BY 1")
def lod_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings and their area by the zoom that shows them."""
    merged = buildings.merge(buildings.fragments(data.features(spark, sf_dir)), data.ORDER)
    return merged.groupBy(lod.bucket(F.col("footprint_m2")).alias("zoom")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("footprint_m2").cast("double")), 1).alias("total_m2"))


@query(f"""WITH {FEATURES}, n AS (SELECT tile, count(*)::DOUBLE AS mean_features FROM f GROUP BY tile UNION ALL SELECT -1, count(*) / count(DISTINCT tile) FROM f)
SELECT tile, round(mean_features, 6) AS mean_features, {level_sql("mean_features", CFG)} AS density_level FROM n""")
def density_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of each tile by itself, and of the whole run as tile -1."""
    rows = data.features(spark, sf_dir)
    each, run = buildings.density(rows, ("tile",)), buildings.density(rows).select(F.lit(-1).cast("long").alias("tile"), "mean_features")
    both = each.select("tile", F.col("mean_features").cast("double")).unionByName(run)
    return both.select("tile", rounded("mean_features", 6), CFG.level(F.col("mean_features")).alias("density_level"))


@query(f"WITH {FEATURES}, {MERGED} SELECT feature_id, n_fragments, round(height, 6) AS height, num_floors::BIGINT AS num_floors, class, subtype, round(first_area, 3) AS first_area_m2 FROM m")
def first_fragment_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that a building takes from its first fragment."""
    merged = buildings.merge(buildings.fragments(data.features(spark, sf_dir)), data.ORDER)
    return merged.select("feature_id", "n_fragments", rounded("height", 6), "num_floors", "class", "subtype", rounded("first_area_m2", 3))


@query(f"WITH {FEATURES}, {MERGED} SELECT feature_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM m")
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of buildings, weighted by fragment area."""
    merged = buildings.merge(buildings.fragments(data.features(spark, sf_dir)), data.ORDER)
    return merged.select("feature_id", rounded("lon", 7), rounded("lat", 7))


@query(f"WITH {FEATURES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(area_m2, 4) AS area_m2 FROM v")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of every fragment."""
    rows = buildings.fragments(data.features(spark, sf_dir))
    return rows.select(F.col("feature_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", rounded("area_m2", 4))


@query("""WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 1 THEN 1 WHEN l_linenumber % 3 = 2 THEN -1 ELSE 0 END AS s,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem),
g AS (SELECT *, sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS p FROM r)
SELECT l_orderkey, p::INT - 1 AS poly_idx, count(*) - 1 AS n_holes FROM g WHERE p > 0 GROUP BY l_orderkey, p""")
def polygon_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of each order grouped to polygons: line 1 of 3 turns one way, line 2 the other, line 3 has no area."""
    point = lambda x, y: F.struct(F.lit(x).alias("px"), F.lit(y).alias("py"))
    outer, hole, flat = (F.array(*[point(x, y) for x, y in p]) for p in ([(0, 0), (9, 0), (9, 9)], [(0, 0), (9, 9), (9, 0)], [(0, 0), (4, 4), (8, 8)]))
    turn = F.col("l_linenumber") % 3
    ring = F.when(turn == 1, outer).when(turn == 2, hole).otherwise(flat)
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    held = data.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), ring.alias("ring")))).alias("r"))
    found = held.select("l_orderkey", F.posexplode(kernels.measured(F.transform("r", lambda x: x["ring"]))).alias("poly_idx", "p"))
    return found.select("l_orderkey", "poly_idx", F.size("p.holes").cast("long").alias("n_holes"))


@query(f"""WITH {FEATURES}, t AS (SELECT DISTINCT tile, x, y, west, south, east, north FROM f),
e AS (SELECT *, (west + east) / 2 AS lo, (south + north) / 2 AS la FROM t), g AS (SELECT *, 6378137 / sqrt(1 - 0.0066943799901413165 * sin(radians(la)) * sin(radians(la))) AS n FROM e)
SELECT tile, round(west, 8) AS west, round(south, 8) AS south, round(east, 8) AS east, round(north, 8) AS north, round(n * cos(radians(la)) * cos(radians(lo)), 3) AS ecef_x,
round(n * cos(radians(la)) * sin(radians(lo)), 3) AS ecef_y, round(n * (1 - 0.0066943799901413165) * sin(radians(la)), 3) AS ecef_z, x::INT AS back_x, y::INT AS back_y,
round(lo, 8) AS back_lon, round(la, 8) AS back_lat, round(radians(east - lo) * 6378137 * cos(radians(la)), 4) AS half_width_m FROM g""")
def tile_geodesy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each tile, its centre in ECEF and back, and half its width in metres."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    rows = tiles_of(spark, sf_dir).withColumn("b", geo.tile_bounds(z, x, y)).withColumn("c", geo.tile_center(z, x, y))
    rows = rows.withColumn("e", geo.wgs84_to_ecef(F.col("c.lon"), F.col("c.lat"), F.lit(0.0))).withColumn("back", geo.ecef_to_wgs84(F.col("e.x"), F.col("e.y"), F.col("e.z")))
    rows = rows.withColumn("t", geo.lonlat_to_tile(z, F.col("c.lon"), F.col("c.lat"))).withColumn("enu", geo.lonlat_to_enu(F.col("b.east"), F.col("c.lat"), F.col("c.lon"), F.col("c.lat")))
    return rows.select(
        "tile", *[rounded(F.col(f"b.{c}"), 8, c) for c in ("west", "south", "east", "north")], *[rounded(F.col(f"e.{c}"), 3, f"ecef_{c}") for c in "xyz"],
        F.col("t.x").alias("back_x"), F.col("t.y").alias("back_y"), rounded(F.col("back.lon"), 8, "back_lon"), rounded(F.col("back.lat"), 8, "back_lat"), rounded(F.col("enu.e"), 4, "half_width_m"),
    )


MESH_URL = "'https://example.org/udx/' || (53394000 + c_custkey % 1500) || CASE WHEN c_custkey % 50 = 0 THEN 'x' ELSE '' END || '_bldg_6697_op.gml'"


@query(f"""WITH u AS (SELECT c_custkey, {MESH_URL} AS url FROM customer), k AS (SELECT *, split_part(split_part(url, '/', -1), '_', 1) AS code FROM u),
b AS (SELECT *, CASE WHEN regexp_matches(code, '^[0-9]{{8}}$') THEN substr(code, 1, 2)::INT / 1.5::DOUBLE + substr(code, 5, 1)::INT * 5 / 60.0::DOUBLE + substr(code, 7, 1)::INT * 30 / 3600.0::DOUBLE END AS south,
  CASE WHEN regexp_matches(code, '^[0-9]{{8}}$') THEN substr(code, 3, 2)::INT + 100 + substr(code, 6, 1)::INT * 7.5::DOUBLE / 60 + substr(code, 8, 1)::INT * 45 / 3600.0::DOUBLE END AS west FROM k)
SELECT c_custkey, code, round(west, 8) AS west, round(south, 8) AS south, round(west + 0.0125::DOUBLE, 8) AS east, round(south + 30 / 3600.0::DOUBLE, 8) AS north,
  coalesce(west <= 139.775 AND west + 0.0125 >= 139.760 AND south <= 35.687 AND south + 30 / 3600.0::DOUBLE >= 35.675, true) AS kept FROM b""")
def mesh_code_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells named in file addresses, and whether a search of the first city keeps the file."""
    rows = data.read(spark, sf_dir, "customer").select("c_custkey", F.expr(MESH_URL).alias("url"))
    rows = rows.withColumn("code", geo.mesh_code_of_url(F.col("url"))).withColumn("b", geo.mesh_code_bbox(F.col("code")))
    box = dict(zip(("west", "south", "east", "north"), truth.CITIES[0][2:6], strict=True))
    kept = F.coalesce(geo.intersects(F.col("b"), box), F.lit(True))
    return rows.select("c_custkey", "code", *[rounded(F.col(f"b.{c}"), 8, c) for c in ("west", "south", "east", "north")], kept.alias("kept"))


CITY_VALUES = ", ".join(f"('{n}', {w}::DOUBLE, {s}::DOUBLE, {e}::DOUBLE, {k}::DOUBLE)" for n, _, w, s, e, k, _ in truth.CITIES)


@query(f"""WITH c(name, west, south, east, north) AS (VALUES {CITY_VALUES}), p AS (SELECT c_custkey, 139.6::DOUBLE + (c_custkey % 200) / 1000.0::DOUBLE AS lon, 35.4::DOUBLE + (c_custkey % 317) / 1000.0::DOUBLE AS lat FROM customer)
SELECT name, sum(CASE WHEN lon BETWEEN west AND east AND lat BETWEEN south AND north THEN 1 ELSE 0 END)::BIGINT AS n_inside,
sum(CASE WHEN lon - 0.01::DOUBLE <= east AND lon + 0.01::DOUBLE >= west AND lat - 0.01::DOUBLE <= north AND lat + 0.01::DOUBLE >= south THEN 1 ELSE 0 END)::BIGINT AS n_touching FROM p, c GROUP BY name""")
def bbox_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in each city's box, and boxes about them that meet it; the five cities are literals of the plan."""
    rows = data.read(spark, sf_dir, "customer").select((F.lit(139.6) + (F.col("c_custkey") % 200) / 1000.0).alias("lon"), (F.lit(35.4) + (F.col("c_custkey") % 317) / 1000.0).alias("lat"))
    box = F.struct((F.col("lon") - 0.01).alias("west"), (F.col("lat") - 0.01).alias("south"), (F.col("lon") + 0.01).alias("east"), (F.col("lat") + 0.01).alias("north"))
    sums = []
    for name, _, w, s, e, n, _ in truth.CITIES:
        city = {"west": w, "south": s, "east": e, "north": n}
        inside, touching = geo.contains(city, F.col("lon"), F.col("lat")), geo.intersects(F.col("b"), city)
        sums.append(F.struct(F.lit(name).alias("name"), F.sum(inside.cast("long")).alias("n_inside"), F.sum(touching.cast("long")).alias("n_touching")))
    return rows.withColumn("b", box).agg(F.array(*sums).alias("s")).select(F.inline("s"))


@query(f"WITH {CITIES}, u AS (SELECT city, unnest(range(tx0, tx1 + 1))::INT AS x, ty0, ty1 FROM cb) SELECT city, 14 AS z, x, unnest(range(ty0, ty1 + 1))::INT AS y FROM u")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that cover the box of each city of a table."""
    return city_table.cover(data.cities(spark, sf_dir))


def evaluated(spark: SparkSession, sf_dir: str, *sets: HeightConfig) -> list[engine.Evaluation]:
    """The run's features against its measured points, for each parameter set; the rest of ORDER changes nothing that is asked for."""
    return engine.compare(data.features(spark, sf_dir), data.truth(spark, sf_dir), sets or (CFG,), data.ORDER[:7], data.outlines(spark, sf_dir), known=True)


@query(f"WITH {FEATURES}, {MERGED}, {buildings_sql(CFG)}, {TRUTH}, {pairs_sql()} SELECT truth_id, feature_id, n_candidates, round(r, 3) + 0.0::DOUBLE AS residual_m FROM p")
def truth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each measured point with the first building whose outline holds it, and the error of its height."""
    return evaluated(spark, sf_dir)[0].pairs.select("truth_id", "feature_id", "n_candidates", rounded("residual_m", 3))


@query(f"WITH {FEATURES}, {MERGED}, {TRUTH} SELECT truth_id FROM t WHERE truth_id NOT IN (SELECT truth_id FROM h)")
def unmatched_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured points within no outline."""
    run = evaluated(spark, sf_dir)[0]
    return spatial.unmatched(run.truth, run.matched).select("truth_id")


STATS_OUT = ", ".join(f"round({c}, 3) + 0.0::DOUBLE AS {c}" if c != "n" else "n" for c in metrics.STATS)


def shown(stats: DataFrame, *keys: str) -> DataFrame:
    return stats.select(*keys, *(rounded(c, 3) if c != "n" else F.col(c) for c in metrics.STATS))


@query(f"WITH {FEATURES}, {MERGED}, {buildings_sql(CFG)}, {TRUTH}, {pairs_sql()}, {stats_sql('p')} SELECT {STATS_OUT}, (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM b) AS n_estimate, (SELECT count(*) FROM t WHERE truth_id NOT IN (SELECT truth_id FROM h)) AS unmatched_truth FROM s WHERE slice_kind = 'overall'")
def residual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over all matched points, with the counters of the run."""
    run = evaluated(spark, sf_dir)[0]
    counted = run.counters()
    overall = metrics.report(run.residuals, *(counted.select(c).scalar() for c in ("n_truth", "n_estimate"))).where("slice_kind = 'overall'")
    return shown(overall.withColumn("unmatched_truth", counted.select("unmatched_truth").scalar()), "n_truth", "n_estimate", "unmatched_truth")


@query(f"WITH {FEATURES}, {MERGED}, {buildings_sql(CFG)}, {TRUTH}, {pairs_sql()}, {stats_sql('p')} SELECT slice_kind, slice, {STATS_OUT} FROM s")
def residual_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics overall, by method, class and subtype."""
    return shown(evaluated(spark, sf_dir)[0].stats, "slice_kind", "slice")


COMPARED = ", ".join(f"round(coalesce({t}.{c}, 0), 3) + 0.0::DOUBLE AS {n}_{c}" if c != "n" else f"coalesce({t}.n, 0) AS {n}_n" for t, n in (("s", "base"), ("u", "cand")) for c in metrics.STATS)


@query(f"WITH {FEATURES}, {MERGED}, {buildings_sql(CFG)}, {buildings_sql(TALL, 'q')}, {TRUTH}, {pairs_sql()}, {pairs_sql('q', 'p2')}, {stats_sql('p')}, {stats_sql('p2', 'u')} SELECT slice_kind, slice, {COMPARED} FROM s FULL JOIN u USING (slice_kind, slice)")
def compare_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parameter sets side by side in every slice."""
    compared = metrics.compare(*(x.stats for x in evaluated(spark, sf_dir, CFG, TALL)))
    return compared.select("slice_kind", "slice", *(F.col(c) if c.endswith("_n") else rounded(c, 3) for c in compared.columns[2:]))


@query(f"WITH {FEATURES}, {MERGED}, {buildings_sql(CFG)}, {TRUTH}, {pairs_sql()}, {stats_sql('p')} SELECT slice, n FROM s WHERE slice_kind = 'class' ORDER BY n DESC, slice LIMIT 10")
def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten classes with most matches."""
    return metrics.top_slices(evaluated(spark, sf_dir)[0].stats, "class").select("slice", "n")


def by_city(spark: SparkSession, sf_dir: str, *sets: HeightConfig) -> list[engine.Evaluation]:
    """The run evaluated in every city's box, all in one plan."""
    return engine.compare(data.features(spark, sf_dir), data.truth_degrees(spark, sf_dir), sets or (CFG,), data.ORDER, cities=data.cities(spark, sf_dir))


@query(f"WITH {FEATURES}, {MERGED}, {TRUTH}, {city_sql(CFG)}, {stats_sql('cp', per='city,')} SELECT city, slice_kind, slice, {STATS_OUT} FROM s")
def city_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every city by slice; density, buildings and points of each are its own."""
    return shown(by_city(spark, sf_dir)[0].stats, "city", "slice_kind", "slice")


@query(f"""WITH {FEATURES}, {MERGED}, {TRUTH}, {city_sql(CFG)}, n AS (SELECT city, count(*) AS n FROM ct GROUP BY city), e AS (SELECT city, count(*) AS n FROM ce GROUP BY city), k AS (SELECT city, count(*) AS n FROM cx GROUP BY city)
SELECT city, coalesce(n.n, 0) AS n_truth, coalesce(e.n, 0) AS n_estimate, coalesce(n.n, 0) - coalesce(k.n, 0) AS unmatched_truth FROM cb LEFT JOIN n USING (city) LEFT JOIN e USING (city) LEFT JOIN k USING (city)""")
def city_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, estimates and unmatched points of every city, also of those without any."""
    return by_city(spark, sf_dir)[0].counters()


@query(f"""WITH {FEATURES}, a AS (SELECT feature_id, x * 4096.0::DOUBLE + px0 AS x0, y * 4096.0::DOUBLE + py0 AS y0, w, h, x, y, l_linenumber % 3 AS kind FROM v),
p AS (SELECT feature_id * 8 + l_linenumber AS truth_id, x * 4096.0::DOUBLE + px0 + w * (feature_id % 10 / 10.0::DOUBLE) + 0.123::DOUBLE AS gx, y * 4096.0::DOUBLE + py0 + h * (feature_id % 7 / 7.0::DOUBLE) + 0.123::DOUBLE AS gy FROM f WHERE l_linenumber <= 3),
c AS (SELECT truth_id, feature_id FROM p JOIN a ON gx >= x0 AND gx < x0 + w AND gy >= y0 AND gy < y0 + h AND a.x BETWEEN floor(gx / 4096) - 1 AND floor(gx / 4096) AND a.y BETWEEN floor(gy / 4096) - 1 AND floor(gy / 4096)
  WHERE CASE kind WHEN 0 THEN (gx - x0) / w + (gy - y0) / h < 1 WHEN 1 THEN gx < x0 + w / 2.0::DOUBLE OR gy < y0 + h / 2.0::DOUBLE ELSE true END)
SELECT truth_id, min(feature_id) AS feature_id, count(DISTINCT feature_id) AS n_candidates FROM c GROUP BY truth_id""")
def outline_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within triangles, angles and rectangles: the first feature that holds each, and how many do."""
    found = spatial.match_points(data.probes(spark, sf_dir), data.shapes(spark, sf_dir), order="feature_id", outlines="ring")
    return found.select("truth_id", "feature_id", "n_candidates")


RASTER_AT = "(x * 31 + y * 17 + {r} * 7 + {c} * 3) % 200"


@query(f"""WITH {FEATURES}, {MERGED}, e AS (SELECT *, x / 16384.0::DOUBLE * 360 - 180 AS west, 360 / 16384.0::DOUBLE AS wide, degrees(atan(sinh(pi() * (1 - 2.0::DOUBLE * y / 16384)))) AS north, degrees(atan(sinh(pi() * (1 - 2.0::DOUBLE * (y + 1) / 16384)))) AS south FROM m),
g AS (SELECT *, (lon - west) / wide * 8 AS px, (north - lat) / (north - south) * 8 AS py FROM e),
k AS (SELECT *, greatest(0, least(7, floor(px)))::INT AS c0, greatest(0, least(7, floor(px) + 1))::INT AS c1, greatest(0, least(7, floor(py)))::INT AS r0, greatest(0, least(7, floor(py) + 1))::INT AS r1, px - floor(px) AS tx, py - floor(py) AS ty FROM g),
s AS (SELECT *, {RASTER_AT.format(r='r0', c='c0')} AS a, {RASTER_AT.format(r='r0', c='c1')} AS b, {RASTER_AT.format(r='r1', c='c0')} AS c, {RASTER_AT.format(r='r1', c='c1')} AS d FROM k)
SELECT feature_id, CASE WHEN tile % 5 = 0 THEN 0 ELSE round((a + (b - a) * tx + ((c + (d - c) * tx) - (a + (b - a) * tx)) * ty)::FLOAT::DOUBLE, 2) END::DOUBLE AS ground_elev FROM s""")
def terrain_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground elevation at each building's centre, 0 on tiles without terrain."""
    merged = buildings.merge(buildings.fragments(data.features(spark, sf_dir)), data.ORDER)
    rasters = data.terrain(spark, sf_dir).withColumn("elev", raster.decode_pixels(F.col("rgb"))).drop("rgb")
    return raster.ground_elevation(merged, rasters).select("feature_id", rounded("ground_elev", 2))


def local_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of every fragment relative to its tile's centre, with a range of heights from 0 to 10 metres."""
    rows = buildings.fragments(data.features(spark, sf_dir))
    placed = kernels.local_rings(F.array("polygon.outer"), F.struct("z", "x", "y", "extent"), geo.tile_center(F.col("z"), F.col("x"), F.col("y")))
    return rows.select("feature_id", F.get(placed, F.lit(0)).alias("ring"), F.lit(0.0).alias("base"), F.lit(10.0).alias("top"))


@query(f"""WITH {FEATURES}, q AS (SELECT *, radians(east - west) * 6378137 * cos(radians((north + south) / 2)) AS we, radians(north - south) * 6378137 AS hn FROM v)
SELECT feature_id, 16 * count(*) AS n_vertices, round(min((px0 / 4096.0::DOUBLE - 0.5::DOUBLE) * we), 2) AS min_x, round(max(((px0 + w) / 4096.0::DOUBLE - 0.5::DOUBLE) * we), 2) AS max_x,
round(min((py0 / 4096.0::DOUBLE - 0.5::DOUBLE) * hn), 2) AS min_z, round(max(((py0 + h) / 4096.0::DOUBLE - 0.5::DOUBLE) * hn), 2) AS max_z, 80.0::DOUBLE * count(*) AS sum_y, 8.0::DOUBLE * count(*) AS sum_abs_nx FROM q GROUP BY feature_id""")
def wall_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of each feature's walls: number, extent, and checks of heights and normals."""
    v = mesh.walls(local_pieces(spark, sf_dir), "feature_id").select("feature_id", F.inline("vertices"))
    return v.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_vertices"), *[F.round(f(c), 2).alias(f"{n}_{c[1]}") for c in ("px", "pz") for f, n in ((F.min, "min"), (F.max, "max"))], F.round(F.sum("py"), 3).alias("sum_y"), F.round(F.sum(F.abs("nx")), 3).alias("sum_abs_nx"))


@query(f"WITH {FEATURES} SELECT feature_id, 8 * count(*) AS n_triangles, 176 * count(*) AS index_sum FROM v GROUP BY feature_id")
def wall_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of each feature's walls, with the sum of their vertex numbers."""
    t = mesh.walls(local_pieces(spark, sf_dir), "feature_id").select("feature_id", F.inline("triangles"))
    return t.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_triangles"), F.sum(F.col("i") + F.col("j") + F.col("k")).cast("long").alias("index_sum"))


@query(f"""WITH {FEATURES}, t AS (SELECT DISTINCT x, y FROM f), r AS (SELECT DISTINCT k AS root_z, x >> (14 - k) AS root_x, y >> (14 - k) AS root_y FROM t, (SELECT unnest(range(0, 12))::INT AS k)),
n AS (SELECT root_z, root_x, root_y, root_z + d AS z, (root_x << d) + i % (1 << d) AS x, (root_y << d) + i // (1 << d) AS y, d FROM r, (SELECT unnest(range(0, 4))::INT AS d), (SELECT unnest(range(0, 64))::INT AS i) WHERE i < (1 << (2 * d)) AND (d < 2 OR root_z = 11))
SELECT root_z, root_x::INT AS root_x, root_y::INT AS root_y, z, x::INT AS x, y::INT AS y, CASE WHEN d = 0 THEN NULL WHEN z >= 12 THEN '/{IMPL}/' || z || '/' || x || '/' || y || '.glb' ELSE '/{IMPL}/sub/' || z || '/' || x || '/' || y || '/tileset.json' END AS uri,
CASE WHEN d = 0 OR z IN (12, 13) THEN 'ADD' END AS refine, round(CASE WHEN z >= 14 THEN 0 ELSE 40075017 / power(2.0::DOUBLE, z) / 30 END::DOUBLE, 4) AS geometric_error,
round(x / power(2.0::DOUBLE, z) * 2 * pi() - pi(), 8) AS west, round(atan(sinh(pi() * (1 - 2 * y / power(2.0::DOUBLE, z)))), 8) AS north FROM n""")
def tileset_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all pyramid documents above the tiles with features."""
    zooms = F.explode(F.sequence(F.lit(0), F.lit(tileset.LEAF_PARENT_Z)))
    rows = tiles_of(spark, sf_dir).select(F.col("x").alias("tx"), F.col("y").alias("ty"), zooms.alias("z"))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), 14 - F.col("z"))).cast("int")
    roots = rows.select("z", up("tx").alias("x"), up("ty").alias("y")).distinct()
    nodes = tileset.sub_tileset_nodes(roots, IMPL)
    return nodes.select("root_z", "root_x", "root_y", "z", "x", "y", "uri", "refine", rounded("geometric_error", 4), rounded(F.col("region")[0], 8, "west"), rounded(F.col("region")[3], 8, "north"))


@query("""WITH r AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 0 THEN '-beta' WHEN o_orderkey % 7 = 0 THEN '/bad' ELSE '' END AS name FROM orders),
g AS (SELECT o_orderpriority, CASE WHEN length(name) > 15 THEN NULL ELSE name END AS name FROM r WHERE regexp_matches(name, '^[0-9]{4}-[0-9]{2}-[0-9]{2}'))
SELECT o_orderpriority, arg_max(name, {'a': substr(name, 1, 10), 'b': NOT name LIKE '%-beta', 'c': name}) AS latest FROM g GROUP BY o_orderpriority""")
def release_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest release among names made of order dates, stable ones before betas."""
    tail = F.expr("case when o_orderkey % 3 = 0 then '-beta' when o_orderkey % 7 = 0 then '/bad' else '' end")
    rows = data.read(spark, sf_dir, "orders").select("o_orderpriority", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), tail).alias("release"))
    return rows.groupBy("o_orderpriority").agg(scalars.latest_release(F.col("release")).alias("latest"))


CONTENT = "count(*) || ':' || sum(l_orderkey)"
HASHES = f"""c AS (SELECT tile, x, y, sha1({CONTENT}) AS s, {CONTENT} AS content FROM f GROUP BY tile, x, y),
k AS (SELECT tile, x, y, substr(sha1('14/' || x || '/' || y || ';f=5,2000;s=1,0;a=0;t=' || CASE WHEN tile % 5 = 0 THEN 'no-terrain' ELSE substr(sha1('terrain ' || tile), 1, 24) END || ';n=1;' || '14/' || x || '/' || y || ':' || substr(s, 1, 32) || ';'), 1, 24) AS hash FROM c)"""


def tile_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each tile's features as its bytes."""
    return data.features(spark, sf_dir).groupBy("tile", "z", "x", "y").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(":"), F.sum("feature_id").cast("string")).cast("binary").alias("content"))


def tile_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of tiles whose bytes are a digest of their features."""
    rows = tile_content(spark, sf_dir)
    land = F.when(F.col("tile") % 5 != 0, F.concat(F.lit("terrain "), F.col("tile").cast("string")).cast("binary"))
    sources = rows.select(F.col("z").alias("out_z"), F.col("x").alias("out_x"), F.col("y").alias("out_y"), "z", "x", "y", "content", F.lit(0).alias("position"))
    return manifest.content_hash(rows.select("z", "x", "y", land.alias("terrain")), sources, lod.area_range(14))


@query(f"WITH {FEATURES}, {HASHES} SELECT 14 AS z, x::INT AS x, y::INT AS y, hash FROM k")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each tile's output."""
    return tile_hashes(spark, sf_dir)


@query(f"WITH {FEATURES}, {HASHES} SELECT 14 AS z, x::INT AS x, y::INT AS y, hash FROM k WHERE hash NOT IN (SELECT hash FROM k WHERE (x + y) % 3 = 0)")
def incremental_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles to render when a third of the outputs is there already."""
    hashes = tile_hashes(spark, sf_dir)
    done = hashes.where((F.col("x") + F.col("y")) % 3 == 0).select("hash", F.lit(IMPL).alias("impl"))
    return manifest.pending(hashes, done, IMPL).select("z", "x", "y", "hash")


@query(f"WITH {FEATURES}, {HASHES} SELECT 14 AS z, x::INT AS x, y::INT AS y, hash, strlen(content)::BIGINT AS n_bytes, sha256(content) AS content_sha256, '{IMPL}' AS impl FROM k JOIN c USING (x, y)")
def output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile's output as a file named by its hash: a part of them written, then the rest, and all read back with their manifest."""
    path = f"{shared_folder(spark)}/outputs-{uuid.uuid4().hex}"
    drawn = tile_hashes(spark, sf_dir).join(tile_content(spark, sf_dir).select("z", "x", "y", F.col("content").alias("glb")), ["z", "x", "y"])
    outputs.write(drawn.where((F.col("x") + F.col("y")) % 3 == 0), path, IMPL)
    outputs.write(manifest.pending(drawn, outputs.manifest(drawn, path), IMPL), path, IMPL)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.glb").load(f"{path}/{IMPL}")
    found = files.select(F.regexp_extract("path", r"([^/]+)\.glb$", 1).alias("hash"), F.sha2("content", 256).alias("content_sha256"))
    return outputs.manifest(drawn, path).join(found, "hash").select("z", "x", "y", "hash", "n_bytes", "content_sha256", "impl")


@query(f"WITH {FEATURES} SELECT x::INT AS x, y::INT AS y, feature_id, round(height, 6) AS height, num_floors::BIGINT AS num_floors, class, subtype, is_underground, px0::INT AS px0, py0::INT AS py0, (px0 + w)::INT AS px1, (py0 + h)::INT AS py1 FROM f")
def mvt_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features written as vector tiles and read back."""
    rows = vector_tiles.read_tiles(data.tiles(spark, sf_dir), ["height", "num_floors", "class", "subtype", "is_underground"], mode="FAILFAST")
    box = lambda f, c: f(F.transform(F.col("rings")[0], lambda p: p[c]))
    return rows.select("x", "y", F.col("feature_id").cast("long").alias("feature_id"), rounded("height", 6), "num_floors", "class", "subtype", "is_underground", box(F.array_min, "px").alias("px0"), box(F.array_min, "py").alias("py0"), box(F.array_max, "px").alias("px1"), box(F.array_max, "py").alias("py1"))


@query(f"""WITH {FEATURES}, k AS (SELECT x, y, CASE (x + y) % 4 WHEN 0 THEN 'damaged' WHEN 1 THEN 'empty' ELSE 'feature' END AS status, count(*) AS n FROM f GROUP BY x, y), r AS (SELECT * FROM k WHERE status <> 'empty')
SELECT x::INT AS x, y::INT AS y, status, CASE WHEN status = 'feature' THEN n ELSE 0 END::BIGINT AS n_features, (SELECT count(*) FROM k) AS tiles, (SELECT count(*) FROM k WHERE status = 'damaged') AS damaged, (SELECT count(*) FROM k WHERE status = 'empty') AS empty FROM r""")
def tile_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector tiles of which some are cut off and some empty: both sides of one pass, with its counts."""
    side = (F.col("x") + F.col("y")) % 4
    content = F.when(side == 0, F.expr("substring(content, 1, octet_length(content) - 3)")).when(side == 1, F.lit(b"")).otherwise(F.col("content"))
    found = vector_tiles.land(data.tiles(spark, sf_dir).withColumn("content", content), f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}", ["height"])
    good = found.features.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_features")).withColumn("status", F.lit("feature"))
    both = good.unionByName(found.damaged.select("x", "y", F.lit(0).cast("long").alias("n_features"), F.lit("damaged").alias("status")))
    return both.select("x", "y", "status", "n_features", *(F.lit(found.counts[c]).cast("long").alias(c) for c in ("tiles", "damaged", "empty")))


@query(f"WITH {FEATURES} SELECT feature_id, 2 * count(*) AS n_triangles, round(sum(area_m2), 2) AS area_m2 FROM v GROUP BY feature_id")
def roof_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ear-clipped roofs of every fragment: triangles and their area, by feature."""
    rows = local_pieces(spark, sf_dir).select("feature_id", F.col("ring").alias("outer"), F.array().cast("array<array<struct<e:double,n:double>>>").alias("holes"), "top")
    flat = mesh.roofs(rows, "feature_id").select("feature_id", "vertices", F.explode("triangles").alias("t"))
    a, b, c = (F.get("vertices", F.col(f"t.{k}")) for k in "ijk")
    area = F.abs((b["px"] - a["px"]) * (c["pz"] - a["pz"]) - (c["px"] - a["px"]) * (b["pz"] - a["pz"])) / 2
    return flat.select("feature_id", area.alias("area")).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_triangles"), F.round(F.sum("area"), 2).alias("area_m2"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber % 3 AS kind, (4 + trunc(l_quantity))::DOUBLE AS w, (4 + 8 * l_linenumber)::DOUBLE AS h FROM lineitem)
SELECT l_orderkey, count(*) AS n_roofs, round(sum(w * h * 0.75::DOUBLE - CASE kind WHEN 0 THEN 0 ELSE kind * w * h / 16 END), 3) AS area_m2 FROM r GROUP BY l_orderkey""")
def roof_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ear-clipped roofs of two arms with up to two holes: their area, of each order."""
    w, h = (4 + F.floor("l_quantity")).cast("double"), (4 + 8 * F.col("l_linenumber")).cast("double")
    ring = lambda *at: F.array(*(F.struct((w * x).alias("e"), (h * y).alias("n")) for x, y in at))
    outer = ring((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))
    box = lambda x: ring((x, 0.125), (x + 0.25, 0.125), (x + 0.25, 0.375), (x, 0.375))
    holes = F.slice(F.array(box(0.125), box(0.625)), F.lit(1), F.col("l_linenumber") % 3)
    lines = data.read(spark, sf_dir, "lineitem")
    rows = data.dealt(lines.select("l_orderkey", "l_quantity", "l_linenumber"), lines).select("l_orderkey", outer.alias("outer"), holes.alias("holes"), F.lit(3.0).alias("top"), F.monotonically_increasing_id().alias("k"))
    flat = mesh.roofs(rows, "l_orderkey", "k").select("l_orderkey", F.expr("aggregate(transform(triangles, t -> abs((vertices[t.j].px - vertices[t.i].px) * (vertices[t.k].pz - vertices[t.i].pz) - (vertices[t.k].px - vertices[t.i].px) * (vertices[t.j].pz - vertices[t.i].pz)) / 2), 0d, (s, v) -> s + v)").alias("area"))
    return flat.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_roofs"), F.round(F.sum("area"), 3).alias("area_m2"))


TILE_MERGED = f"""
d AS (SELECT x, y, count(*)::DOUBLE AS mean FROM f GROUP BY x, y),
m0 AS (SELECT x, y, feature_id, sum(area_m2)::FLOAT AS footprint_m2, count(*) AS n_fragments,
         arg_min({{'height': height, 'num_floors': num_floors, 'class': class, 'subtype': subtype, 'area': area_m2}}, {ORDER}) AS r
       FROM v GROUP BY x, y, feature_id),
m AS (SELECT m0.*, r.height AS height, r.num_floors AS num_floors, r.class AS class, r.subtype AS subtype, r.area::FLOAT::DOUBLE AS first_area, {level_sql("d.mean", CFG)} AS lv FROM m0 JOIN d USING (x, y)),
b AS (SELECT *, {cascade_sql(CFG, "lv", "first_area")[0]} AS height_m FROM m WHERE footprint_m2 >= 5 AND footprint_m2 < 2000)"""


@query(f"""WITH {FEATURES}, {TILE_MERGED}, t AS (SELECT DISTINCT x, y FROM f)
SELECT t.x::INT AS x, t.y::INT AS y, count(feature_id) AS n_buildings, coalesce(20 * sum(n_fragments), 0)::BIGINT AS n_vertices, coalesce(30 * sum(n_fragments), 0)::BIGINT AS n_indices,
round(coalesce(sum(height_m::DOUBLE), 0), 2) AS sum_height, coalesce(sum(feature_id), 0)::BIGINT AS sum_feature_id FROM t LEFT JOIN b USING (x, y) GROUP BY ALL""")
def glb_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tile's glb holds, read back from its bytes: buildings, vertices, indices, heights and ids."""
    rasters = data.terrain(spark, sf_dir).withColumn("elev", raster.decode_pixels(F.col("rgb"))).drop("rgb")
    packed = engine.render_tiles(data.features(spark, sf_dir), rasters, CFG, data.ORDER)
    return glb.contents(packed).select("tile.x", "tile.y", "n_buildings", "n_vertices", "n_indices", rounded("sum_height", 2), "sum_feature_id")


@query("""SELECT c_custkey, CASE WHEN length(u) > 100 THEN u[:60] || '…' || u[-36:] ELSE u END AS short, q AS encoded FROM (
SELECT c_custkey, 'https://example.org/' || repeat('a b*~/', (c_custkey % 30)::INT) || c_name AS u, repeat('a%20b%2A~%2F', (c_custkey % 30)::INT) AS q FROM customer)""")
def url_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened and percent-encoded addresses."""
    part = F.repeat(F.lit("a b*~/"), (F.col("c_custkey") % 30).cast("int"))
    return data.read(spark, sf_dir, "customer").select("c_custkey", scalars.short_url(F.concat(F.lit("https://example.org/"), part, F.col("c_name"))).alias("short"), scalars.percent_encode(part).alias("encoded"))


@query(f"WITH {FEATURES}, {MERGED}, {TRUTH} SELECT t.truth_id, printf('%.2f', truth_m::DOUBLE) AS line FROM t WHERE truth_m > 0 AND abs(truth_m + 9999) >= 0.5")
def truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured heights that pass the sentinel filter, as text."""
    rows = data.truth(spark, sf_dir).where(truth.valid_height(F.col("truth_m")))
    return rows.select("truth_id", scalars.fixed(F.col("truth_m").cast("double"), 2).alias("line"))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '-' || p_size WHEN 2 THEN p_size || '.5' WHEN 3 THEN ' ' || p_size WHEN 4 THEN p_size || 'd' WHEN 5 THEN '+' || p_size WHEN 6 THEN '4294967296' WHEN 7 THEN '-0' ELSE '1e' || (p_size % 12) END AS t, p_retailprice * CASE p_partkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 1e9 ELSE 1 END AS v FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(t, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN round(t::DOUBLE, 4) + 0.0::DOUBLE END AS as_double,
CASE WHEN regexp_full_match(t, '[+]?[0-9]+') AND t::HUGEINT <= 4294967295 THEN t::BIGINT END AS as_u32, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN t::BIGINT END AS as_i64,
CASE WHEN v >= 0 THEN least(floor(v + 0.5), 4294967295)::BIGINT END AS from_double, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS from_whole FROM s""")
def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute values of other types as numbers."""
    text = F.expr("case p_partkey % 9 when 0 then string(p_size) when 1 then concat('-', p_size) when 2 then concat(p_size, '.5') when 3 then concat(' ', p_size) when 4 then concat(p_size, 'd') when 5 then concat('+', p_size) when 6 then '4294967296' when 7 then '-0' else concat('1e', p_size % 12) end")
    value = F.expr("double(p_retailprice) * case p_partkey % 4 when 0 then -1 when 1 then 1e9 else 1 end")
    whole = F.when(F.col("p_partkey") % 3 == 0, -F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).cast("long")
    rows = data.read(spark, sf_dir, "part").select("p_partkey", text.alias("t"), value.alias("v"), whole.alias("w"))
    return rows.select("p_partkey", rounded(scalars.text_to_double(F.col("t")), 4, "as_double"), scalars.text_to_u32(F.col("t")).alias("as_u32"), scalars.text_to_i64(F.col("t")).alias("as_i64"), scalars.double_to_u32(F.col("v")).alias("from_double"), scalars.integer_to_u32(F.col("w")).alias("from_whole"))


@query("""WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'glb' WHEN 1 THEN 'root' ELSE 'sub' END AS kind, o_orderkey % 11 = 0 AS failed FROM orders)
SELECT k, CASE WHEN failed THEN 503 ELSE 200 END AS status, CASE WHEN NOT failed THEN '"' || md5(k::VARCHAR) || '"' END AS etag,
CASE WHEN failed THEN 'no-store' WHEN kind = 'glb' THEN 'public, max-age=300' WHEN kind = 'root' THEN 'public, max-age=60' ELSE 'public, max-age=2592000, immutable' END AS cache_control, CASE WHEN failed THEN 2 END AS retry_after FROM t""")
def response_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, tag, cache policy and retry of outputs."""
    rows = data.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("hash"), F.expr("case o_orderkey % 3 when 0 then 'glb' when 1 then 'root' else 'sub' end").alias("kind"), (F.col("o_orderkey") % 11 == 0).alias("failed"))
    return manifest.response(rows).select("k", "status", "etag", "cache_control", "retry_after")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 410 WHEN o_orderkey % 7 = 0 THEN 404 WHEN o_orderkey % 3 = 0 THEN 400 WHEN o_orderkey % 20 NOT BETWEEN 12 AND 14 THEN 404 ELSE 200 END AS status FROM orders""")
def route_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What asking for addresses made of orders gives."""
    k = F.col("o_orderkey")
    status = tileset.address_status(F.when(k % 5 != 0, IMPL), IMPL, F.when(k % 7 == 0, "png").otherwise("glb"), (k % 20).cast("double"), F.when(k % 3 == 0, float("nan")).otherwise(1.0), F.lit(2.0), 12, 14)
    return data.read(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@query(f"""WITH {FEATURES}, t AS (SELECT DISTINCT x, y, radians((west + east) / 2) AS l, radians((north + south) / 2) AS p FROM f),
n AS (SELECT *, 6378137 / sqrt(1 - 0.00669437999014131699613723 * sin(p) * sin(p)) AS r FROM t)
SELECT x::INT AS x, y::INT AS y, round(-sin(l), 8) + 0.0::DOUBLE AS m0, round(-cos(l), 8) AS m2, round(cos(p) * cos(l), 8) AS m4, round(sin(p), 8) AS m5, round(-cos(p) * sin(l), 8) AS m6, round(sin(p) * cos(l), 8) AS m8, round(-cos(p), 8) AS m9, round(-sin(p) * sin(l), 8) AS m10,
round(r * cos(p) * cos(l), 3) AS m12, round(r * (1 - 0.00669437999014131699613723) * sin(p), 3) AS m13, round(-r * cos(p) * sin(l), 3) AS m14 FROM n""")
def tile_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each tile's mesh stands: the y-up placement of its centre, column by column."""
    middle = geo.tile_center(F.col("z"), F.col("x"), F.col("y"))
    rows = tiles_of(spark, sf_dir).select("x", "y", geo.y_up(geo.enu_to_ecef(middle["lon"], middle["lat"], F.lit(0.0))).alias("m"))
    return rows.select("x", "y", *(rounded(F.get("m", F.lit(k)), 8 if k < 12 else 3, f"m{k}") for k in (0, 2, 4, 5, 6, 8, 9, 10, 12, 13, 14)))


@query(f"""WITH {FEATURES}, t AS (SELECT DISTINCT x, y FROM f), u AS (SELECT x, y FROM (SELECT unnest(range(14550, 14556)) AS x), (SELECT unnest(range(6450, 6456)) AS y))
SELECT u.x::INT AS x, u.y::INT AS y, count(t.x) > 0 AS there FROM u LEFT JOIN t USING (x, y) GROUP BY ALL""")
def cover_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that cover a box, and whether the run has them."""
    n = 1 << 14
    lon, lat = (lambda x: x / n * 360 - 180), (lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / n)))))
    asked = tileset.cover(spark, lon(14550.5), lat(6455.5), lon(14555.5), lat(6450.5))
    return asked.join(tiles_of(spark, sf_dir).select("z", "x", "y", F.lit(True).alias("there")), ["z", "x", "y"], "left").select("x", "y", F.coalesce("there", F.lit(False)).alias("there"))


def landed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as a landed truth set: a catalogue of files per nation, id lists, and attribute batches."""
    rows = data.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("double").alias("h"))
    url = F.concat(F.lit("https://example.org/bldg/"), F.lpad((53394500 + F.col("c_nationkey")).cast("string"), 8, "0"), F.lit("_bldg.gml"))
    rows = rows.withColumn("url", url)
    files = rows.select("url").distinct().groupBy().agg(F.sort_array(F.collect_list(F.struct("url"))).alias("bldg"))
    catalogue = files.select(F.to_json(F.struct(F.array(F.struct(F.struct("bldg").alias("files"))).alias("cities"))).alias("json"))
    name = F.format_string("id-%09d", "c_custkey")
    lists = rows.groupBy("url").agg(F.to_json(F.struct(F.collect_list(name).alias("featureIds"))).alias("json"))
    batch = F.floor((F.row_number().over(Window.partitionBy("url").orderBy("c_custkey")) - 1) / 200).cast("int")
    centre = F.struct(F.struct((139 + F.col("c_custkey") % 1000 / 1000).alias("lng"), (35 + F.col("c_custkey") % 700 / 1000).alias("lat")).alias("center"))
    height = F.when(F.col("c_custkey") % 13 == 0, -9999.0).otherwise(F.col("h") / 97)
    one = F.struct(height.alias("bldg:measuredHeight"), F.when(F.col("c_custkey") % 17 != 0, centre).alias("_bbox"))
    answers = rows.select("url", batch.alias("batch"), one.alias("r")).groupBy("url", "batch").agg(F.to_json(F.collect_list("r")).alias("json"))
    return catalogue, lists, answers


BOX = {"west": 139.1, "south": 35.1, "east": 139.9, "north": 35.67}


@query("""WITH r AS (SELECT 139 + c_custkey % 1000 / 1000 AS lon, 35 + c_custkey % 700 / 1000 AS lat, (CASE WHEN c_custkey % 13 = 0 THEN -9999 ELSE c_acctbal::DOUBLE / 97 END)::DOUBLE AS h, c_custkey, c_nationkey FROM customer),
k AS (SELECT *, 53394500 + c_nationkey AS code FROM r),
b AS (SELECT *, substr(code::VARCHAR, 1, 2)::INT / 1.5::DOUBLE + substr(code::VARCHAR, 5, 1)::INT * 5 / 60.0::DOUBLE + substr(code::VARCHAR, 7, 1)::INT * 30 / 3600.0::DOUBLE AS south, substr(code::VARCHAR, 3, 2)::INT + 100 + substr(code::VARCHAR, 6, 1)::INT * 7.5::DOUBLE / 60 + substr(code::VARCHAR, 8, 1)::INT * 45 / 3600.0::DOUBLE AS west FROM k)
SELECT printf('%.7f,%.7f,%.2f', lon, lat, h::FLOAT::DOUBLE) AS line FROM b
WHERE h > 0 AND c_custkey % 17 <> 0 AND lon BETWEEN 139.1 AND 139.9 AND lat BETWEEN 35.1 AND 35.67 AND south <= 35.67 AND south + 30 / 3600.0::DOUBLE >= 35.1 AND west <= 139.9 AND west + 45 / 3600.0::DOUBLE >= 139.1""")
def truth_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured points of a box as text, from the catalogue to the attribute batches."""
    return truth.csv_lines(truth.composed(*landed(spark, sf_dir), BOX))


@query("""WITH i AS (SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 200 AS batch FROM customer)
SELECT 'https://example.org/bldg/' || (53394500 + c_nationkey) || '_bldg.gml' AS url, batch::INT AS batch, count(*)::INT AS n_ids, 'id-' || lpad(min(c_custkey)::VARCHAR, 9, '0') AS first_id FROM i GROUP BY ALL""")
def id_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of 200 ids of each file of the catalogue."""
    catalogue, lists, _ = landed(spark, sf_dir)
    asked = truth.batches(truth.feature_ids(lists.join(truth.file_urls(catalogue), "url", "left_semi")))
    return asked.select("url", "batch", F.size("ids").alias("n_ids"), F.get("ids", F.lit(0)).alias("first_id"))
