"""Boundary cases of filters, merging, density, the height cascade, and the levels of detail."""

from __future__ import annotations

import dataclasses
import math
import random

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rooftide import engine
from rooftide.functions import kernels
from rooftide.functions.config import HeightConfig, cascade
from rooftide.operators import buildings, lod, metrics

CFG = HeightConfig()
SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]
SCHEMA = "feature_id decimal(20,0), z int, x int, y int, extent int, rings array<array<struct<px:int,py:int>>>, source_idx int, feat_idx int, height double, num_floors bigint, class string, subtype string, is_underground boolean, level bigint"


def features(spark: SparkSession, rows: list[dict]) -> DataFrame:
    base = {"feature_id": None, "z": 14, "x": 0, "y": 8000, "extent": 4096, "rings": [SQUARE], "source_idx": 0, "height": None, "num_floors": None, "class": None, "subtype": None, "is_underground": None, "level": None}
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    from decimal import Decimal

    listed = [base | {"feat_idx": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(Decimal(v) if n == "feature_id" and v is not None else v for n, v in ((n, r[n]) for n in names)) for r in listed], SCHEMA)


def test_underground_features_go(spark: SparkSession) -> None:
    rows = features(spark, [{"feature_id": 1}, {"feature_id": 2, "is_underground": True}, {"feature_id": 3, "level": -1}, {"feature_id": 4, "level": 0, "is_underground": False}])
    assert sorted(int(r.feature_id) for r in buildings.extract_buildings(rows).collect()) == [1, 4]


def test_null_ids_never_merge(spark: SparkSession) -> None:
    two = [(p[0] + 200, p[1]) for p in SQUARE]
    rows = features(spark, [{}, {}, {"rings": [SQUARE, two]}, {"feature_id": 7, "rings": [SQUARE, two]}, {"feature_id": 2**64 - 1}])
    found = buildings.extract_buildings(rows).collect()
    assert len(found) == 6 and max(r.feature_id for r in found if r.feature_id) == 2**64 - 1
    shared, alone = (next(r for r in found if r.feature_id == k) for k in (7, 2**64 - 1))
    assert shared.footprint_m2 == pytest.approx(2 * alone.footprint_m2, rel=1e-5) and shared.n_fragments == 2


@pytest.mark.parametrize(("height", "floors", "kind", "subtype", "area", "level", "want"), [
    (0.0, 2, None, None, 1.0, "rural", (6.6, "num_floors")),
    (float("nan"), None, "house", None, 1.0, "rural", (6.0, "class")),
    (None, None, "House", "medical", 1.0, "rural", (18.0, "subtype")),
    (12.5, 9, "house", None, 1.0, "rural", (12.5, "explicit")),
    (None, 0, None, None, 1.0, "suburban", (6.0, "density")),
    (None, None, None, None, 59.9, "urban", (9.0, "density")),
    (None, None, None, None, 60.0, "urban", (9.0, "density")),
    (None, None, None, None, 199.9, "urban", (9.0, "density")),
    (None, None, None, None, 200.0, "urban", (12.0, "density")),
    (None, None, None, None, 59.9, "dense_urban", (12.0, "density")),
    (None, None, None, None, 60.0, "dense_urban", (15.0, "density")),
    (None, None, None, None, 800.0, "dense_urban", (24.0, "density")),
    (None, None, None, None, 5e9, "rural", (10.0, "footprint")),
])
def test_cascade(spark: SparkSession, height, floors, kind, subtype, area, level, want) -> None:
    row = spark.createDataFrame([(height, floors, kind, subtype, area, level)], "h double, n bigint, c string, s string, a double, l string")
    got = row.select(cascade(CFG, *map(F.col, "hncsal")).alias("x")).first().x
    assert (got.height_m, got.height_method) == (pytest.approx(want[0]), want[1])


def test_empty_curve_and_density_edges(spark: SparkSession) -> None:
    bare = HeightConfig(footprint={k: () for k in CFG.footprint})
    assert spark.range(1).select(bare.curve(F.lit("urban"), F.lit(5.0))).first()[0] == 3.0
    rows = spark.createDataFrame([(199.99,), (200.0,), (800.0,), (1500.0,)], "m double")
    assert [r[0] for r in rows.orderBy("m").select(CFG.level(F.col("m"))).collect()] == ["rural", "suburban", "urban", "dense_urban"]
    assert len(CFG.class_height_m) == 69 and len(CFG.subtype_height_m) == 13


def test_merged_or_first_fragment_area(spark: SparkSession) -> None:
    dense = HeightConfig(thresholds=(0.0, 0.0, 0.0))
    side = 8  # pixels of about 0.6 metres at the equator
    one = [(0, 0), (12, 0), (12, side), (0, side), (0, 0)]
    rows = features(spark, [{"feature_id": 7, "y": 8191, "rings": [one, [(x + 50, y) for x, y in one]]}])
    area = buildings.fragments(rows).first().area_m2
    assert 30 < area < 60
    assert buildings.extract_buildings(rows, dense).first().height_m == (15.0 if 2 * area >= 60 else 12.0)
    assert buildings.extract_buildings(rows, dense, height_area="first_fragment").first().height_m == 12.0


def test_density_counts_hidden_features_and_empty_tiles(spark: SparkSession) -> None:
    rows = features(spark, [{"is_underground": True}, {}, {"x": 1}])
    assert buildings.density(rows).first().mean_features == 1.5
    empty = spark.createDataFrame([(14, 0, 8000), (14, 5, 5)], "z int, x int, y int")
    assert buildings.density(rows, sources=empty).first().mean_features == 1.0


def test_ring_grouping(spark: SparkSession) -> None:
    outer, hole, flat = [(0, 0), (9, 0), (9, 9)], [(0, 0), (9, 9), (9, 0)], [(0, 0), (4, 4), (8, 8)]
    row = spark.createDataFrame([([hole, outer, hole, flat, outer, [(1, 1), (2, 2)]],)], "rings array<array<struct<px:int,py:int>>>")
    got = row.select(kernels.polygons(F.col("rings")).alias("p")).first().p
    assert [len(p.holes) for p in got] == [2, 0]


def test_evaluate_and_compare(spark: SparkSession) -> None:
    square = lambda k: [(400 * k, 0), (400 * k + 100, 0), (400 * k + 100, 100), (400 * k, 100)]
    table = features(spark, [{"feature_id": k, "rings": [square(k)], "height": 10.0 * k if k < 3 else None, "class": "office" if k == 3 else None} for k in range(1, 6)])
    n = 1 << 14
    lon = lambda px: px / 4096 / n * 360 - 180
    north, south = (math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / n)))) for y in (8000, 8001))
    lat = north + (south - north) * 50 / 4096
    points = [(k, lon(400 * k + 50), lat, 12.0 * k) for k in range(1, 6)] + [(99, lon(399), lat, 5.0)]
    truth = spark.createDataFrame(points, "truth_id int, lon double, lat double, truth_m float")
    plain, tall = engine.compare(table, truth, (CFG, dataclasses.replace(CFG, class_height_m=CFG.class_height_m | {"office": 36.0})))
    pairs = {r.truth_id: (r.feature_id, r.residual_m) for r in plain.pairs.collect()}
    assert {k: int(f) for k, (f, _) in pairs.items()} == {k: k for k in range(1, 6)} and pairs[1][1] == -2 and pairs[2][1] == -4 and pairs[3][1] == 4
    assert {r.truth_id: r.residual_m for r in tall.pairs.collect()}[3] == 0
    assert plain.counters().first().asDict() == {"n_truth": 6, "n_estimate": 5, "unmatched_truth": 1}
    stats = {(r.slice_kind, r.slice): r.n for r in plain.stats.collect()}
    assert stats["overall", "all"] == 5 and stats["height_method", "explicit"] == 2 and stats["class", "office"] == 1
    assert engine.evaluate(table, truth, CFG).stats.where("slice_kind = 'overall'").first().n == 5
    compared = metrics.compare(plain.stats, tall.stats).withColumn("city", F.lit("here"))
    assert "| here | 5 |" in metrics.summary(compared) and "n_truth=6" in metrics.console(plain.stats, {"n_truth": 6})


def polygons_by_hand(rows: list) -> list:
    """(outer, holes, area, mean) of each polygon of a row of rings."""
    out = []
    for k, ring in enumerate(rows or []):
        ring = ring[:-1] if ring and len(ring) > 1 and ring[0] == ring[-1] else ring or []
        if len(ring) < 3 or any(c is None for p in ring for c in p):
            continue
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
        if area > 0:
            out.append([k, [], area, [sum(c) / len(ring) for c in zip(*ring, strict=True)]])
        elif out:
            out[-1][1].append(k)
            out[-1][2] -= abs(area)
    return [(a, b, max(c, 0.0), d) for a, b, c, d in out]


def test_rings_by_hand(spark: SparkSession) -> None:
    rng = random.Random(5)
    point = lambda: (rng.randint(0, 30), rng.randint(0, 30))
    ring = lambda: (lambda r: r + r[:1] if r and rng.random() < 0.5 else r)([point() for _ in range(rng.randint(0, 6))])
    rows = [(i, [ring() for _ in range(rng.randint(0, 5))]) for i in range(300)] + [(300, None), (301, []), (302, [None, [(0, 0), (9, 0), (9, 9)]]), (303, [[(0, 0), (None, 1), (9, 9), (0, 9)]])]
    table = spark.createDataFrame(rows, "id int, rings array<array<struct<px:int,py:int>>>").repartition(3)
    for r in table.select("id", kernels.measured(F.col("rings")).alias("m")).collect():
        want = polygons_by_hand(rows[r.id][1])
        assert [(p.outer, p.holes) for p in r.m] == [w[:2] for w in want]
        assert [x for p in r.m for x in (p.area, p.px, p.py)] == pytest.approx([x for w in want for x in (w[2], *w[3])])


def test_area_ranges(spark: SparkSession) -> None:
    areas = [4.99, 5.0, 1999.9, 2000.0, 9999.9, 10000.0]
    rows = spark.createDataFrame([(a,) for a in areas], "a double").orderBy("a")
    assert [r[0] for r in rows.select(lod.bucket(F.col("a"))).collect()] == [None, 14, 14, 13, 13, 12]
    for z in (12, 13, 14):
        hit = [r[0] for r in rows.where(lod.in_range(F.col("a"), *lod.area_range(z))).collect()]
        assert hit == [a for a, b in zip(areas, [None, 14, 14, 13, 13, 12], strict=True) if b == z]
    assert lod.area_range(13, "replace") == (0.0, 0.0) and lod.refine(12, "replace") == "REPLACE" and lod.refine(14, "replace") == "ADD" and lod.simplify(12, "replace") == (0.25, 12.0)
    got = spark.range(1).select(lod.geometric_error(F.lit(14)), lod.geometric_error(F.lit(12))).first()
    assert got[0] == 0 and round(got[1], 2) == 326.13


def test_export_sentinels(spark: SparkSession) -> None:
    found = buildings.export_columns(buildings.extract_buildings(features(spark, [{"num_floors": 70000}]))).first()
    assert found.feature_id == 0 and found.gers_id == "" and found.source_height == 0 and found.num_floors == 65535 and len(found) == 13


def test_toml_round_trip() -> None:
    assert HeightConfig.from_toml(CFG.to_toml()) == CFG
    tables = "meters_per_floor = 3\n[class_height_m]\na = 1\n[subtype_height_m]\n[urban_thresholds]\nsuburban_min = 1\nurban_min = 2\ndense_urban_min = 3\n"
    tables += "".join(f"[[footprint.{k}.buckets]]\nmax_area_m2 = 5\nheight_m = 2\n" for k in CFG.footprint)
    got = HeightConfig.from_toml(tables)
    assert got.footprint["rural"] == ((5.0, 2.0),) and got.thresholds == (1.0, 2.0, 3.0)
    with pytest.raises(KeyError):
        HeightConfig.from_toml("meters_per_floor = 3")
