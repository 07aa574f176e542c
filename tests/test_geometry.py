"""Geodesy, ring tests, spatial matching, statistics, rasters."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rooftide.functions import geo, rings, scalars
from rooftide.operators import metrics, raster, spatial, tileset
from rooftide.sources import releases, truth

WORLD = "lon double, lat double"


def one(spark: SparkSession, *columns):
    return spark.range(1).select(*columns).first()


def test_tile_maths(spark: SparkSession) -> None:
    b = one(spark, geo.tile_bounds(F.lit(1), F.lit(0), F.lit(0)))[0]
    assert (b.west, b.east, round(b.south, 9)) == (-180, 0, 0) and b.north == pytest.approx(85.0511287798)
    t = one(spark, geo.lonlat_to_tile(F.lit(14), F.lit(139.767), F.lit(35.681)), geo.lonlat_to_tile(F.lit(2), F.lit(200.0), F.lit(-89.9)))
    assert (t[0].x, t[0].y) == (14552, 6451) and (t[1].x, t[1].y) == (3, 3)


def test_ecef_there_and_back(spark: SparkSession) -> None:
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.uniform(-180, 180), rng.uniform(-89, 89), rng.uniform(-100, 5000)) for _ in range(50)], "lon double, lat double, h double")
    e = rows.withColumn("e", geo.wgs84_to_ecef(F.col("lon"), F.col("lat"), F.col("h"))).withColumn("b", geo.ecef_to_wgs84(F.col("e.x"), F.col("e.y"), F.col("e.z")))
    for r in e.collect():
        assert r.b.lon == pytest.approx(r.lon) and r.b.lat == pytest.approx(r.lat, abs=1e-8) and r.b.height == pytest.approx(r.h, abs=1e-3)
    m = one(spark, geo.enu_to_ecef(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("m"), geo.y_up(geo.enu_to_ecef(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("y"))
    assert m.m[:3] == [0, 1, 0] and m.m[8:11] == [1, 0, 0] and m.m[12:15] == [geo.A, 0, 0]
    assert [round(v, 9) for v in m.y[:4]] == [0, 0, -1, 0] and m.y[12:] == [geo.A, 0, 0, 1]


def test_mesh_codes_and_boxes(spark: SparkSession) -> None:
    b = one(spark, geo.mesh_code_bbox(F.lit("53394509")).alias("b")).b
    assert b.south == pytest.approx(53 / 1.5 + 20 / 60) and b.west == pytest.approx(139.7375) and b.north - b.south == pytest.approx(30 / 3600)
    rows = spark.createDataFrame([("https://x/53394509_bldg.gml",), ("https://x/abc_y",), ("https://x/5339450",), ("https://x/53390000_z",)], "url string")
    box = {"west": 139.74, "south": 35.6, "east": 139.75, "north": 35.7}
    assert truth.prune(rows, box).count() == 3
    edge = {"west": 0.0, "south": 0.0, "east": 1.0, "north": 1.0}
    assert one(spark, *[geo.contains(edge, F.lit(x), F.lit(y)) for x, y in ((0.0, 0.5), (1.0, 1.0), (1.01, 0.5))])[:] == (True, True, False)
    other = F.struct(F.lit(1.0).alias("west"), F.lit(0.0).alias("south"), F.lit(2.0).alias("east"), F.lit(1.0).alias("north"))
    assert one(spark, geo.intersects(other, edge))[0] is True


def inside(ring: list, x: float, y: float) -> bool:
    out = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            out = not out
    return out


def test_points_match_the_first_outline(spark: SparkSession) -> None:
    rng = random.Random(3)
    polygons = []
    for i in range(150):
        cx, cy, r = rng.random(), rng.random(), rng.choice([0.01, 0.02, 0.3])
        polygons.append((i, [[(cx + r * rng.uniform(0.5, 1) * math.cos(a), cy + r * rng.uniform(0.5, 1) * math.sin(a)) for a in sorted(rng.uniform(0, 6.28) for _ in range(7))], [(0.0, 0.0), (0.0, 0.0)]]))
    points = [(i, rng.random(), rng.random()) for i in range(500)]
    est = spark.createDataFrame(polygons, "estimate_idx int, outer_rings array<array<struct<lon:double,lat:double>>>")
    pts = spark.createDataFrame(points, "truth_id int, lon double, lat double")
    got = spatial.match_points(pts, est, target=300)
    want = {}
    for i, x, y in points:
        if hit := [k for k, r in polygons if inside(r[0], x, y)]:
            want[i] = (min(hit), len(hit))
    assert {r.truth_id: (r.estimate_idx, r.n_candidates) for r in got.collect()} == want
    assert spatial.unmatched(pts, got).count() == 500 - len(want)


def test_statistics(spark: SparkSession) -> None:
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]), rng.choice(["x", "y", None]), rng.choice([None, "s"]), rng.gauss(0, 9), rng.choice([0.0, 5.0, 30.0])) for _ in range(400)] + [("c", "z", None, v, 2 * v) for v in (1.0, 2.0, 3.0, 4.0)]
    stats = {(r.slice_kind, r.slice): r for r in metrics.slice_statistics(spark.createDataFrame(rows, "height_method string, class string, subtype string, residual_m double, truth_m double")).collect()}
    assert {k for k, _ in stats} == set(metrics.SLICES) and (stats["class", "z"].p50_abs, stats["class", "z"].p90_abs) == (3.0, 4.0)
    assert stats["class", "z"].within_50pct == 0  # exactly half isn't within
    for k, pick in (("overall", lambda r: "all"), ("height_method", lambda r: r[0]), ("class", lambda r: r[1]), ("subtype", lambda r: r[2])):
        for name in {pick(r) for r in rows} - {None}:
            own = [r for r in rows if pick(r) == name]
            a, s = sorted(abs(r[3]) for r in own), stats[k, name]
            assert s.n == len(own) and s.mae == pytest.approx(sum(a) / len(a)) and s.bias == pytest.approx(sum(r[3] for r in own) / len(own))
            assert s.p50_abs == a[len(a) // 2] and s.p90_abs == a[min(len(a) * 90 // 100, len(a) - 1)]
            assert s.within_20pct == pytest.approx(sum(r[4] > 0 and abs(r[3]) / r[4] < 0.2 for r in own) / len(own))
    assert sum(s.n for (k, _), s in stats.items() if k == "height_method") == stats["overall", "all"].n


def test_reports(spark: SparkSession) -> None:
    kinds = "height_method string, class string, subtype string, residual_m double, truth_m double"
    base = metrics.slice_statistics(spark.createDataFrame([("a", "x", None, 2.0, 10.0)] * 3, kinds))
    cand = metrics.slice_statistics(spark.createDataFrame([("b", "x", None, 1.0, 10.0)] * 3, kinds))
    both = metrics.compare(base, cand)
    row = both.where("slice = 'b'").first()
    assert row.base_n == 0 and row.base_mae == 0 and row.cand_n == 3
    assert metrics.arrow(1.0, 1.0005) == "" and metrics.arrow(2, 1) == "✅" and metrics.arrow(0.2, 0.1, False) == "⚠️"
    assert "| x | 3 | 2.00 → 1.00 ✅" in metrics.markdown(both, "city") and "overall" in metrics.console(base)
    empty = metrics.report(spark.createDataFrame([], kinds), 5, 6).collect()
    assert len(empty) == 1 and empty[0].n == 0 and empty[0].n_truth == 5


def test_raster(spark: SparkSession) -> None:
    assert one(spark, raster.metres(F.lit(128), F.lit(0), F.lit(0)))[0] == 0
    elev = F.array(*[F.lit(float(v)) for v in (0, 10, 20, 30)])
    at = lambda x, y: raster.sample(elev, F.lit(2), F.lit(2), F.lit(x), F.lit(y))
    assert one(spark, at(0.0, 0.0), at(0.25, 0.25), at(1.0, 1.0), at(-0.5, 0.0))[:] == (0, 15, 30, 0)


def test_scalars(spark: SparkSession) -> None:
    got = one(spark, *[scalars.zigzag(F.lit(v).cast("long")) for v in (0, 1, 2, 3)])[:]
    assert got == (0, -1, 1, -2)
    text = one(spark, *[scalars.text_to_double(F.lit(s)) for s in ("3.5", " 3 ", "1d", "x")], scalars.text_to_u32(F.lit("4294967296")), scalars.double_to_u32(F.lit(2.5)), scalars.double_to_u32(F.lit(1e30)), scalars.integer_to_u32(F.lit(-1).cast("long")))
    assert text[:] == (3.5, None, None, None, None, 3, 4294967295, None)
    assert one(spark, scalars.percent_encode(F.lit("a b*~-_.é")))[0] == "a%20b%2A~-_.%C3%A9"
    assert one(spark, scalars.fnv1a64(F.lit("a")))[0] == "af63dc4c8601ec8c"
    texts = ["", None, "a", "foobar", "é" * 50, "x"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)

    def slow(t: str) -> str:
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    assert {r.i: r.h for r in table.select("i", scalars.fnv1a64(F.col("t")).alias("h")).collect()} == {i: None if t is None else slow(t) for i, t in enumerate(texts)}
    assert [scalars.truthy(v) for v in (None, "", "0", "False", "1", "yes")] == [False] * 4 + [True] * 2


@pytest.mark.parametrize(("names", "want"), [(["2024-06-13", "2024-06-13-beta", "2024-05-16"], "2024-06-13"), (["2024-06-13-beta", "2024-05-16"], "2024-06-13-beta"), (["latest"], None)])
def test_release_pick(spark: SparkSession, names: list[str], want: str | None) -> None:
    xml = "".join(f"<Prefix>tiles/{n}/</Prefix>" for n in names)
    assert releases.latest(releases.names(spark.createDataFrame([(xml,)], "xml string"))).first()[0] == want


def test_truth_json(spark: SparkSession) -> None:
    catalogue = '{"cities":[{"files":{"bldg":[{"url":"https://x/53394509_a.gml"},{"url":"https://x/abc_b.gml"}]}},{"files":{}}]}'
    assert truth.file_urls(spark.createDataFrame([(catalogue,)], "json string")).count() == 2
    ids = truth.feature_ids(spark.createDataFrame([("u", '{"featureIds":["a",5,"b",null]}')], "url string, json string"))
    assert sorted(r.feature_id for r in ids.collect()) == ["a", "b"]
    many = spark.range(450).select(F.lit("u").alias("url"), F.format_string("%05d", "id").alias("feature_id"))
    assert sorted(len(r.ids) for r in truth.batches(many).collect()) == [50, 200, 200]
    heights = [0, -1, -9999, -9999.4, 0.1]
    batch = "[" + ",".join(f'{{"bldg:measuredHeight":{h},"_bbox":{{"center":{{"lng":1,"lat":2}}}}}}' for h in heights) + ',{"bldg:measuredHeight":5}]'
    got = truth.records(spark.createDataFrame([(batch,)], "json string")).collect()
    assert [round(r.measured_height_m, 3) for r in got] == [0.1]
    assert truth.cities(spark).count() == 5 and truth.cities(spark, "iiyama").first().city_code == "20213"


def test_pyramid(spark: SparkSession) -> None:
    import json

    roots = spark.createDataFrame([(11, 1819, 806), (3, 1, 2)], "z int, x int, y int")
    nodes = tileset.sub_tileset_nodes(roots, "v1-add").cache()
    assert nodes.where("root_z = 11 and z >= 12").count() == 84 and nodes.where("root_z = 3").count() == 5
    docs = {r.root_z: json.loads(r.json) for r in tileset.sub_tileset_json(nodes).collect()}
    top = docs[11]["root"]
    assert top["refine"] == "ADD" and "content" not in top and [len(c["children"]) for c in top["children"]] == [4] * 4
    leaf = top["children"][1]["children"][2]["children"][3]
    assert leaf["content"]["uri"] == "/v1-add/14/14557/6451.glb" and leaf["geometricError"] == 0 and "children" not in leaf and "refine" not in leaf
    assert docs[3]["root"]["children"][3]["content"]["uri"] == "/v1-add/sub/4/3/5/tileset.json"
    assert json.loads(tileset.root_tileset("v1-add"))["root"]["content"]["uri"] == "/v1-add/sub/0/0/0/tileset.json"
    with pytest.raises(LookupError):
        tileset.check_address(12, 0, 0, 0, 11)
    assert tileset.cover(spark, 139.760, 35.675, 139.775, 35.687).count() >= 2


def test_area_does_not_depend_on_the_first_vertex(spark: SparkSession) -> None:
    ring = [(0, 0), (50, 3), (60, 40), (20, 70), (-5, 30)]
    rows = spark.createDataFrame([(ring[k:] + ring[:k],) for k in range(5)], "r array<struct<px:int,py:int>>")
    assert len({r[0] for r in rows.select(rings.signed_area(F.col("r"))).collect()}) == 1
