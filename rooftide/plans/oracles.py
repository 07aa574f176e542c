"""DuckDB SQL for the registered queries; rectangles have closed forms for what the engine computes on rings."""

from __future__ import annotations

from ..functions.config import HeightConfig

ORDER = "{'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_quantity, 'e': l_extendedprice, 'f': l_discount, 'g': l_tax, 'h': l_returnflag, 'i': l_linestatus, 'j': l_shipdate}"

FEATURES = """
f0 AS (
  SELECT l.*, p_size, l_orderkey AS feature_id,
         CASE WHEN l_orderkey % 1000 < 5 THEN 100 + l_orderkey % 1000 ELSE ((l_orderkey % 500) * (l_orderkey % 500)) // 2500 END
         + CASE WHEN l_linenumber = 2 AND l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS tile,
         (l_partkey * 37) % 3800 AS px0, (l_suppkey * 101) % 3800 AS py0,
         CASE WHEN l_orderkey % 97 = 1 THEN 3 ELSE (4 + CAST(trunc(l_quantity) AS INT)) * CASE WHEN l_orderkey % 50 = 0 THEN 5 ELSE 1 END END AS w,
         CASE WHEN l_orderkey % 97 = 1 THEN 3 ELSE (4 + 8 * l_linenumber) * CASE WHEN l_orderkey % 50 = 0 THEN 5 ELSE 1 END END AS h
  FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey),
f1 AS (
  SELECT *, 14552 + tile % 11 AS x, 6451 + tile // 11 AS y,
         CASE WHEN l_discount >= 0.09 THEN 3 + l_extendedprice / 1000 END AS height,
         CASE WHEN l_tax >= 0.07 THEN 1 + l_linenumber END AS num_floors,
         CASE p_size % 10 WHEN 0 THEN 'house' WHEN 1 THEN 'apartments' WHEN 2 THEN 'office' WHEN 3 THEN 'unknown_class' END AS class,
         CASE p_size % 3 WHEN 0 THEN 'residential' WHEN 1 THEN 'unknown_sub' END AS subtype,
         l_quantity = 13 AND l_tax < 0.01 AS is_underground FROM f0),
f2 AS (
  SELECT *, x / 16384.0::DOUBLE * 360 - 180 AS west, (x + 1) / 16384.0::DOUBLE * 360 - 180 AS east,
         degrees(atan(sinh(pi() * (1 - 2.0::DOUBLE * y / 16384)))) AS north, degrees(atan(sinh(pi() * (1 - 2.0::DOUBLE * (y + 1) / 16384)))) AS south FROM f1),
f AS (
  SELECT *, w * h * radians(east - west) / 4096 * 6378137 * cos(radians((north + south) / 2)) * radians(north - south) / 4096 * 6378137 AS area_m2,
         west + (east - west) * (px0 + w / 2.0::DOUBLE) / 4096 AS lon, north + (south - north) * (py0 + h / 2.0::DOUBLE) / 4096 AS lat FROM f2),
v AS (SELECT * FROM f WHERE coalesce(NOT is_underground, true))"""

MERGED = f"""
m0 AS (
  SELECT feature_id, sum(area_m2)::FLOAT AS footprint_m2, sum(lon * area_m2) / sum(area_m2) AS lon, sum(lat * area_m2) / sum(area_m2) AS lat, count(*) AS n_fragments,
         arg_min({{'height': height, 'num_floors': num_floors, 'class': class, 'subtype': subtype, 'x': x, 'y': y, 'tile': tile, 'px0': px0, 'py0': py0, 'w': w, 'h': h, 'area': area_m2}}, {ORDER}) AS r
  FROM v GROUP BY feature_id),
m AS (SELECT feature_id, footprint_m2, lon, lat, n_fragments, r.height AS height, r.num_floors AS num_floors, r.class AS class, r.subtype AS subtype, r.x AS x, r.y AS y, r.tile AS tile, r.px0 AS px0, r.py0 AS py0, r.w AS w, r.h AS h, r.area AS first_area FROM m0)"""


def level_sql(mean: str, cfg: HeightConfig) -> str:
    suburban, urban, dense = cfg.thresholds
    return f"CASE WHEN {mean} >= {dense} THEN 'dense_urban' WHEN {mean} >= {urban} THEN 'urban' WHEN {mean} >= {suburban} THEN 'suburban' ELSE 'rural' END"


def cascade_sql(cfg: HeightConfig, level: str, area: str) -> tuple[str, str]:
    """CASE expressions for metres and method."""
    pick = lambda table, c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(table.items())) + " END"
    of = lambda buckets: "CASE " + " ".join(f"WHEN {area} < {end} THEN {h}" for end, h in buckets) + f" ELSE {buckets[-1][1]} END"
    curve = f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {of(b)}" for k, b in sorted(cfg.footprint.items())) + " END"
    kind, sub = pick(cfg.class_height_m, "class"), pick(cfg.subtype_height_m, "subtype")
    steps = [("height > 0 AND NOT isnan(height)", "height", "'explicit'"), ("num_floors > 0", f"num_floors * {cfg.meters_per_floor}::DOUBLE", "'num_floors'"), (f"{kind} IS NOT NULL", kind, "'class'"), (f"{sub} IS NOT NULL", sub, "'subtype'")]
    metres = "(CASE " + " ".join(f"WHEN {c} THEN ({m})::DOUBLE" for c, m, _ in steps) + f" ELSE ({curve})::DOUBLE END)::FLOAT"
    method = "CASE " + " ".join(f"WHEN {c} THEN {n}" for c, _, n in steps) + f" WHEN {level} = 'rural' THEN 'footprint' ELSE 'density' END"
    return metres, method


def buildings_sql(cfg: HeightConfig, name: str = "b") -> str:
    """CTEs that end in the building table with density over all tiles."""
    metres, method = cascade_sql(cfg, "lv", "footprint_m2::DOUBLE")
    return f"""
{name}d AS (SELECT {level_sql("(SELECT count(*) / count(DISTINCT tile) FROM f)", cfg)} AS lv),
{name} AS (SELECT m.*, {metres} AS height_m, {method} AS height_method FROM m, {name}d)"""


TRUTH = """
t AS (
  SELECT o_orderkey AS truth_id, x * 4096.0::DOUBLE + px0 + w / 2.0::DOUBLE + CASE WHEN o_orderkey % 4 = 0 THEN 5000 ELSE 0 END AS gx,
         y * 4096.0::DOUBLE + py0 + h / 2.0::DOUBLE AS gy, (3 + o_totalprice / 10000)::FLOAT AS truth_m
  FROM orders JOIN m ON o_orderkey = feature_id),
c AS (
  SELECT truth_id, feature_id FROM t JOIN v ON gx >= x * 4096 + px0 AND gx < x * 4096 + px0 + w AND gy > y * 4096 + py0 AND gy <= y * 4096 + py0 + h
    AND v.x BETWEEN floor(gx / 4096) - 1 AND floor(gx / 4096) AND v.y BETWEEN floor(gy / 4096) - 1 AND floor(gy / 4096)),
h AS (SELECT truth_id, min(feature_id) AS feature_id, count(DISTINCT feature_id) AS n_candidates FROM c GROUP BY truth_id)"""


def pairs_sql(name: str = "b", out: str = "p") -> str:
    return f"""
{out} AS (
  SELECT h.truth_id, h.feature_id, h.n_candidates, (height_m::FLOAT - truth_m)::FLOAT::DOUBLE AS r, truth_m::DOUBLE AS tm, height_method, class, subtype
  FROM h JOIN t USING (truth_id) JOIN {name} ON {name}.feature_id = h.feature_id)"""


def stats_sql(pairs: str, out: str = "s", per: str = "") -> str:
    kinds = [("overall", "'all'"), ("height_method", "height_method"), ("class", "class"), ("subtype", "subtype")]
    long = " UNION ALL ".join(f"SELECT {per} '{k}' AS slice_kind, {c} AS slice, r, tm FROM {pairs}" for k, c in kinds)
    return f"""
{out}k AS ({long}),
{out} AS (
  SELECT {per} slice_kind, slice, count(*) AS n, avg(abs(r)) AS mae, sqrt(avg(r * r)) AS rmse, avg(r) AS bias,
         list_sort(list(abs(r)))[1 + least(count(*) * 50 // 100, count(*) - 1)] AS p50_abs, list_sort(list(abs(r)))[1 + least(count(*) * 90 // 100, count(*) - 1)] AS p90_abs,
         avg(CASE WHEN tm > 0 AND abs(r) / tm < 0.2::DOUBLE THEN 1 ELSE 0 END) AS within_20pct, avg(CASE WHEN tm > 0 AND abs(r) / tm < 0.5::DOUBLE THEN 1 ELSE 0 END) AS within_50pct
  FROM {out}k WHERE slice IS NOT NULL GROUP BY ALL)"""


CITIES = """
ck AS (SELECT n_name AS city, 14552 + n_nationkey % 5 * 2 + 0.3::DOUBLE AS x0, 6451 + n_nationkey // 5 * 2 + 0.2::DOUBLE AS y0 FROM nation),
cb AS (SELECT city, floor(x0)::INT AS tx0, floor(x0 + 2.3::DOUBLE)::INT AS tx1, floor(y0)::INT AS ty0, floor(y0 + 1.9::DOUBLE)::INT AS ty1, x0 / 16384 * 360 - 180 AS b_west, (x0 + 2.3::DOUBLE) / 16384 * 360 - 180 AS b_east,
         degrees(atan(sinh(pi() * (1 - 2 * y0 / 16384)))) AS b_north, degrees(atan(sinh(pi() * (1 - 2 * (y0 + 1.9::DOUBLE) / 16384)))) AS b_south FROM ck)"""


def city_sql(cfg: HeightConfig) -> str:
    """CTEs of features, buildings, points and matches of every city; ends in ``ce`` (estimates), ``ct`` (points) and ``cp`` (pairs)."""
    metres, method = cascade_sql(cfg, "lv", "footprint_m2::DOUBLE")
    return f"""
{CITIES},
cf AS (SELECT city, f.* FROM f JOIN cb ON f.x BETWEEN tx0 AND tx1 AND f.y BETWEEN ty0 AND ty1),
cv AS (SELECT * FROM cf WHERE coalesce(NOT is_underground, true)),
cm0 AS (
  SELECT city, feature_id, sum(area_m2)::FLOAT AS footprint_m2, sum(lon * area_m2) / sum(area_m2) AS lon, sum(lat * area_m2) / sum(area_m2) AS lat,
         arg_min({{'height': height, 'num_floors': num_floors, 'class': class, 'subtype': subtype}}, {ORDER}) AS r FROM cv GROUP BY city, feature_id),
cd AS (SELECT city, {level_sql("count(*) / count(DISTINCT tile)", cfg)} AS lv FROM cf GROUP BY city),
cm AS (SELECT city, feature_id, footprint_m2, lon, lat, r.height AS height, r.num_floors AS num_floors, r.class AS class, r.subtype AS subtype, lv FROM cm0 JOIN cd USING (city)),
ch AS (SELECT *, {metres} AS height_m, {method} AS height_method FROM cm),
ce AS (SELECT ch.* FROM ch JOIN cb USING (city) WHERE lon BETWEEN b_west AND b_east AND lat BETWEEN b_south AND b_north),
tg AS (SELECT truth_id, truth_m, gx + 0.123::DOUBLE AS gx, gy + 0.217::DOUBLE AS gy, floor((gy + 0.217::DOUBLE) / 4096) AS ty FROM t),
td AS (SELECT *, gx / 4096 / 16384 * 360 - 180 AS lon, degrees(atan(sinh(pi() * (1 - 2 * ty / 16384)))) AS n, degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 16384)))) AS s FROM tg),
ct AS (SELECT city, truth_id, truth_m, gx, gy FROM td JOIN cb ON lon BETWEEN b_west AND b_east AND n + (s - n) * (gy / 4096 - ty) BETWEEN b_south AND b_north),
cc AS (
  SELECT DISTINCT ct.city, truth_id, cv.feature_id FROM ct JOIN cv ON ct.city = cv.city AND gx > x * 4096 + px0 AND gx < x * 4096 + px0 + w AND gy > y * 4096 + py0 AND gy < y * 4096 + py0 + h
    AND cv.x BETWEEN floor(gx / 4096) - 1 AND floor(gx / 4096) AND cv.y BETWEEN floor(gy / 4096) - 1 AND floor(gy / 4096)),
cx AS (SELECT city, truth_id, min(feature_id) AS feature_id FROM cc JOIN ce USING (city, feature_id) GROUP BY city, truth_id),
cp AS (SELECT city, truth_id, feature_id, (height_m::FLOAT - truth_m)::FLOAT::DOUBLE AS r, truth_m::DOUBLE AS tm, height_method, class, subtype FROM cx JOIN ct USING (city, truth_id) JOIN ce USING (city, feature_id))"""
