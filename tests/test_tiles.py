"""Tile decoding, meshes, glb packing, manifests and the stream."""

from __future__ import annotations

import functools
import gzip
import http.server
import json
import random
import struct
import threading
from collections.abc import Callable
from pathlib import Path

import numpy as np
import plain_tiles
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rooftide.operators import glb, manifest, mesh
from rooftide.plans.bindings import _varint, encode_tile
from rooftide import engine
from rooftide.sources import archive, tile_columns, vector_tiles
from rooftide.streaming import rerender

SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100)]


def test_wire_primitives() -> None:
    assert vector_tiles.varint(b"\xac\x02", 0) == (300, 2)
    assert [vector_tiles.zigzag(v) for v in (0, 1, 2, 3)] == [0, -1, 1, -2]
    for bad in (b"\x80", b"\xff" * 11, b"\x1a\x05ab", b"\x0b"):
        with pytest.raises(vector_tiles.TileError):
            list(vector_tiles.messages(bad))


def geometry(numbers: list[int]) -> list:
    found, fault = tile_columns.rings(np.array(numbers, np.uint64), np.array([len(numbers)]))
    assert not fault[0], tile_columns.FAULTS[fault[0]]
    return [[(p["px"], p["py"]) for p in ring] for ring in found.to_pylist()[0]]


@pytest.mark.parametrize("read", [geometry, plain_tiles.polygon_rings])
def test_geometry_commands(read: Callable) -> None:
    move, line, close = 1 << 3 | 1, 2 << 3 | 2, 1 << 3 | 7
    assert read([move, 2, 2, line, 4, 0, 0, 4, close]) == [[(1, 1), (3, 1), (3, 3), (1, 1)]]
    assert read([close]) == [[]] and read([close, close]) == [[], []] and read([]) == []
    assert read([move, 0, 0, move, 2, 2]) == [[(0, 0)], [(1, 1)]] == read([2 << 3 | 1, 0, 0, 2, 2])
    assert read([line, 2, 2, 0, 0, close, line, 2, 2, 0, 0]) == [[(1, 1), (1, 1)], [(2, 2), (2, 2)]]
    assert read([move, 2**32 - 2, 0, 1 << 3 | 2, 2, 0]) == [[(2**31 - 1, 0), (-(2**31), 0)]]
    for bad in ([3], [move, 2], [close, 0], [2**63 | 2, 1, 1]):
        with pytest.raises((AssertionError, vector_tiles.TileError), match="command|geometry"):
            read(bad)


def rough_tile(rng: random.Random, layer: str) -> bytes:
    """A tile of odd parts: any command stream, attributes of all types, unknown keys and fields, tags out of range."""
    field = lambda n, data: _varint(n << 3 | 2) + _varint(len(data)) + data
    value = lambda: rng.choice([field(1, rng.choice(["3.5", "-7", "Haus", "true"]).encode()), _varint(2 << 3 | 5) + struct.pack("<f", rng.uniform(-9, 9)), _varint(3 << 3 | 1) + struct.pack("<d", rng.uniform(-1e9, 1e20)), *(_varint(k << 3) + _varint(rng.choice([0, 1, 3, 2**63 + 5, 2**64 - 2])) for k in (4, 5, 6, 7)), b""])
    keys = rng.sample([*vector_tiles.ATTRIBUTES, "@name", "other", "id"], 9)
    out = []
    for _ in range(rng.randrange(6)):
        stream = []
        for _ in range(rng.randrange(7)):
            command, count = rng.choice([(1, 1), (1, 2), (2, 0), (2, 3), (7, 1), (7, 1)])
            stream += [count << 3 | command, *([rng.choice([0, 0, 3, 4, 2**31, 2**32 - 1, 2**40 + 1]) for _ in range(2 * count)] if command < 3 else [])]
        tags = [rng.choice([*range(11), 2**63]) for _ in range(rng.randrange(14))]
        parts = [field(2, b"".join(map(_varint, tags))), _varint(3 << 3) + _varint(rng.choice([3, 3, 3, 2])), field(4, b"".join(map(_varint, stream))), field(9, b"any"), _varint(8 << 3 | 5) + b"1234", _varint(7 << 3 | 1) + b"12345678"]
        parts += [_varint(1 << 3) + _varint(rng.choice([0, 5, 2**64 - 1]))] if rng.random() < 0.7 else []
        out.append(field(2, b"".join(rng.sample(parts, rng.randrange(len(parts) + 1)))))
    body = [field(1, layer.encode()), *out, *(field(3, k.encode()) for k in keys), *(field(4, value()) for _ in range(9)), _varint(5 << 3) + _varint(512)]
    return field(3, b"".join(body if rng.random() < 0.5 else body[::-1]))


def test_tiles_by_columns_are_those_read_plainly() -> None:
    rng, wanted, contents, damaged = random.Random(5), list(vector_tiles.ATTRIBUTES), [b""], 0
    for _ in range(1500):
        data = b"".join(rough_tile(rng, rng.choice(["building", "building", "roads"])) for _ in range(rng.randrange(1, 4)))
        if rng.random() < 0.5:  # damage: a byte changed, or the end cut off
            at = rng.randrange(len(data))
            data = data[:at] + (bytes([rng.randrange(256)]) + data[at + 1 :] if rng.random() < 0.7 else b"")
        contents.append(data)
    found, reasons = vector_tiles.decode_tiles(contents, wanted)
    columns = {c: pa.array([vector_tiles.attribute(vector_tiles.ATTRIBUTES[c], v, c) for v in values], vector_tiles.ARROW[vector_tiles.ATTRIBUTES[c]]).take(at).to_pylist() for c, (values, at) in zip(wanted, found.values, strict=True)}
    got: dict[int, list] = {}
    for k, (tile, number, extent, ident, rings) in enumerate(zip(found.tile.tolist(), found.number.tolist(), found.extent.tolist(), found.ident.to_pylist(), found.rings.to_pylist(), strict=True)):
        row = {c: v[k] for c, v in columns.items() if v[k] is not None}
        got.setdefault(tile, []).append((number, extent, ident, [[(p["px"], p["py"]) for p in r] for r in rings], row))
    for tile, data in enumerate(contents):
        try:
            extent, features = plain_tiles.decode_tile(data, wanted)
        except vector_tiles.TileError:
            assert reasons[tile] and tile not in got
            damaged += 1
            continue
        want = [(f["feat_idx"], extent, f["feature_id"], f["rings"], {c: f[c] for c in wanted if f.get(c) is not None}) for f in features]
        assert reasons[tile] is None and got.get(tile, []) == want
    assert 300 < damaged < 1000 and len(found.tile) > 500


def test_attribute_coercion() -> None:
    a = vector_tiles.attribute
    assert [a("double", v, "height") for v in ("3.5", " 3", True, 2, None)] == [3.5, None, None, 2.0, None]
    assert [a("bigint", v, "num_floors") for v in (2.5, -1, -1.0, 1e30, "7", "x", 2**33)] == [3, None, None, 2**32 - 1, 7, None, None]
    assert [a("bigint", v, "level") for v in (-2, -2.5, "-3")] == [-2, -3, -3]
    assert a("string", 3, "class") is None and a("boolean", True, "has_parts") is True and a("boolean", "true", "has_parts") is None


def test_read_tiles(spark: SparkSession) -> None:
    good = encode_tile([{"id": 2**64 - 1, "rings": [SQUARE], "height": 10.0, "class": "house", "level": -1, "@name": "N", "id_": "x"}, {"id": None, "rings": [SQUARE, SQUARE[::-1]], "is_underground": True}])
    other = encode_tile([{"id": 5, "rings": [SQUARE]}], layer="roads")
    rows = [(14, 1, 2, good + other), (14, 1, 3, gzip.compress(good)), (14, 1, 4, b""), (14, 1, 5, b"\x1a\xff"), (14, 1, 6, good + encode_tile([{"id": 9, "rings": [SQUARE]}]))]
    tiles = spark.createDataFrame(rows, "z int, x int, y int, content binary")
    found = vector_tiles.read_tiles(tiles).orderBy("y", "feat_idx").collect()
    assert [r.y for r in found] == [2, 2, 3, 3, 6] and [r.feature_id for r in found][-1] == 9
    assert found[0].feature_id == 2**64 - 1 and found[0].height == 10 and found[0].name == "N" and found[0].level == -1 and found[0].extent == 4096
    assert found[1].feature_id is None and len(found[1].rings) == 2 and found[1].is_underground and found[0].rings[0][0] == found[0].rings[0][-1]
    with pytest.raises(Exception, match="truncated|end"):
        vector_tiles.read_tiles(tiles, mode="FAILFAST").collect()


def build_archive(tiles: dict[tuple[int, int, int], bytes], leaf: int = 0, packed: int = 2) -> bytes:
    """A pyramid file; with ``leaf`` its directory is split into leaves of so many entries."""
    pack = {1: bytes, 2: gzip.compress, 4: zstandard.compress}[packed]
    entries, data = [], b""
    for number, content in sorted((archive.tile_number(*k), v) for k, v in tiles.items()):
        entries.append((number, 1, len(content), len(data)))
        data += content

    def listed(rows: list[tuple[int, int, int, int]]) -> bytes:
        columns = [[n - (rows[i - 1][0] if i else 0) for i, (n, *_) in enumerate(rows)], [r for _, r, _, _ in rows], [s for _, _, s, _ in rows], [o + 1 for *_, o in rows]]
        return pack(_varint(len(rows)) + b"".join(_varint(v) for c in columns for v in c))

    leaves, root = b"", entries
    if leaf:
        root = []
        for k in range(0, len(entries), leaf):
            part = listed(entries[k : k + leaf])
            root.append((entries[k][0], 0, len(part), len(leaves)))
            leaves += part
    top = listed(root)
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(top), 0, 0, 127 + len(top), len(leaves), 127 + len(top) + len(leaves), len(data))
    head += bytes(97 - len(head)) + bytes([packed]) + bytes(29)
    return head + top + leaves + data


@pytest.mark.parametrize(("leaf", "packed"), [(0, 1), (5, 2), (3, 4)])
def test_archive_is_walked_and_probed_alike(spark: SparkSession, tmp_path: Path, leaf: int, packed: int, monkeypatch: pytest.MonkeyPatch) -> None:
    tiles = {(z, x, y): f"{z}/{x}/{y}".encode() for z in range(5) for x in range(1 << z) for y in range(1 << z) if (x * 7 + y) % 3}
    place = tmp_path / f"{leaf}-{packed}.pmtiles"
    place.write_bytes(build_archive(tiles, leaf, packed))
    found = []
    for few in (4096, 10):
        monkeypatch.setattr(archive, "FEW", few)
        for path in (str(place), f"file://{place}"):
            reader = archive.TileReader({"path": path, "z": "4"})
            found.append(sorted(row for part in reader.partitions() for row in reader.read(part)))
    assert all(rows == sorted((*k, v) for k, v in tiles.items() if k[0] == 4) for rows in found)
    monkeypatch.setattr(archive, "FEW", 0)
    box = {"path": str(place), "z": "4", "west": "1", "east": "60", "south": "1", "north": "50"}
    walked = archive.TileReader(box)
    monkeypatch.setattr(archive, "FEW", 4096)
    probed = archive.TileReader(box)
    assert sorted(r for p in walked.partitions() for r in walked.read(p)) == sorted(r for p in probed.partitions() for r in probed.read(p))
    one = archive.TileReader({"path": str(place), "z": "4", "x": "3", "y": "4"})
    assert [r for p in one.partitions() for r in one.read(p)] == [(4, 3, 4, b"4/3/4")]


def test_archive_addresses_and_retries() -> None:
    assert all(archive.tile_address(archive.tile_number(z, x, y)) == (z, x, y) for z in range(6) for x in range(1 << z) for y in range(1 << z))
    assert archive.tile_address(archive.tile_number(14, 14552, 6451)) == (14, 14552, 6451)
    calls = []

    def flaky() -> bytes:
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost")
        return b"x"

    assert archive.again(flaky, 4, 0.001) == b"x" and len(calls) == 3
    with pytest.raises(OSError, match="lost"):
        archive.again(lambda: (_ for _ in ()).throw(OSError("lost")), 2, 0.001)


def test_archive_over_http(tmp_path: Path) -> None:
    tiles = {(2, x, y): f"{x},{y}".encode() for x in range(4) for y in range(4)}
    (tmp_path / "a.pmtiles").write_bytes(build_archive(tiles, 3))

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    reader = archive.TileReader({"path": f"http://127.0.0.1:{server.server_port}/a.pmtiles", "z": "2"})
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 16
    server.shutdown()


def test_archive_source(spark: SparkSession, tmp_path: Path) -> None:
    numbers = {archive.tile_number(z, x, y) for z in range(4) for x in range(1 << z) for y in range(1 << z)}
    assert numbers == set(range(85))
    assert [archive.tile_number(1, *p) for p in ((0, 0), (0, 1), (1, 1), (1, 0))] == [1, 2, 3, 4]
    tiles = {(3, x, y): f"{x},{y}".encode() for x in range(8) for y in range(8) if (x + y) % 3}
    (tmp_path / "a.pmtiles").write_bytes(build_archive(tiles))
    spark.dataSource.register(archive.TileArchive)
    rows = spark.read.format("tile_archive").option("path", f"{tmp_path}/a.pmtiles").option("z", 3).load().collect()
    assert {(r.z, r.x, r.y): bytes(r.content) for r in rows} == tiles
    box = spark.read.format("tile_archive").options(path=f"{tmp_path}/a.pmtiles", z="3", west="1", east="44", south="1", north="40").load()
    assert {(r.x, r.y) for r in box.collect()} == {p for p in ((4, 3), (4, 2)) if (3, *p) in tiles}


def area(p: np.ndarray) -> float:
    return float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum() / 2)


def test_ear_clipping_covers_the_polygon() -> None:
    rng = random.Random(2)
    for n in (3, 4, 9, 30):
        angles = sorted(rng.uniform(0, 6.28) for _ in range(n))
        outer = np.array([(rng.uniform(3, 9) * np.cos(a), rng.uniform(3, 9) * np.sin(a)) for a in angles])
        outer = np.array([np.hypot(*p) * np.array([np.cos(a), np.sin(a)]) for p, a in zip(outer, angles, strict=True)])
        t = mesh.triangulate(outer, [])
        assert sum(abs(area(outer[list(k)])) for k in t) == pytest.approx(abs(area(outer))) and len(t) == n - 2
    outer = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    holes = [np.array([(2, 2), (4, 2), (4, 4), (2, 4)], float), np.array([(6, 6), (8, 6), (8, 8), (6, 8)], float)]
    points = np.concatenate([outer, *holes])
    assert sum(abs(area(points[list(k)])) for k in mesh.triangulate(outer, holes)) == pytest.approx(92)


def test_walls(spark: SparkSession) -> None:
    ring = [{"e": float(x), "n": float(y)} for x, y in SQUARE]
    rows = spark.createDataFrame([(1, ring, 0.0, 5.0)], "fid int, ring array<struct<e:double,n:double>>, base double, top double")
    made = mesh.walls(rows.unionByName(rows.withColumn("ring", F.reverse("ring")).withColumn("fid", F.lit(2))).unionByName(rows.withColumn("ring", F.lit(None).cast(rows.schema["ring"].dataType)).withColumn("fid", F.lit(3))), "fid").cache()
    assert {r.fid: (len(r.vertices), len(r.triangles)) for r in made.collect()} == {1: (16, 8), 2: (16, 8), 3: (0, 0)}
    v, t = (made.select("fid", F.inline(c)).collect() for c in ("vertices", "triangles"))
    assert [(r.i, r.j, r.k) for r in t[:2]] == [(0, 2, 1), (0, 3, 2)]
    for r in v:  # normals point away from the middle (50, -50)
        assert (r.px - 50) * r.nx + (r.pz + 50) * r.nz > 0


def test_decimation() -> None:
    n = 24
    x, z = (c.ravel() for c in np.meshgrid(np.arange(n, dtype=float), np.arange(n, dtype=float)))
    points = np.stack([x, np.zeros(n * n), z], 1)
    corner = (np.arange(n - 1)[:, None] * n + np.arange(n - 1)).ravel()
    triangles = np.concatenate([np.stack([corner, corner + n, corner + 1], 1), np.stack([corner + 1, corner + n, corner + n + 1], 1)])
    for ratio in (0.5, 0.25, 0.05):
        few = mesh.decimate(points, triangles, ratio, 100.0)
        assert 0 < len(few) <= len(triangles) * ratio and few.max() < len(points)
        a, b, c = (points[few[:, k]] for k in range(3))
        assert (np.cross(b - a, c - a)[:, 1] >= 0).all() and np.cross(b - a, c - a)[:, 1].sum() / 2 > 0.6 * (n - 1) ** 2
    assert mesh.decimate(points, triangles, 1.0, 0.0) is triangles and len(mesh.decimate(points, triangles[:1], 0.5, 1.0)) == 1
    assert len(mesh.decimate(points, triangles, 0.01, 1e-6)) > len(triangles) // 2  # the error allows no more


def test_render_tiles_at_each_zoom(spark: SparkSession) -> None:
    rings = [[(100 * k, 50 * j) for k, j in ((i, 0), (i + 1, 0), (i + 1, 2), (i, 2), (i, 0))] for i in range(0, 30, 3)]
    rows = [(i, 12, 3638, 1612, 4096, [r], 0, i, 10.0 + i, None, None) for i, r in enumerate(rings)] + [(99, 12, 3638, 1613, 4096, [[(0, 0), (1, 0), (1, 1)]], 0, 0, 5.0, None, None)]
    table = spark.createDataFrame(rows, "feature_id long, z int, x int, y int, extent int, rings array<array<struct<px:int,py:int>>>, source_idx int, feat_idx int, height double, class string, subtype string")
    plain = {r.tile.y: r for r in glb.contents(engine.render_tiles(table, zoom=12)).collect()}
    assert (plain[1612].n_buildings, plain[1612].n_vertices, plain[1612].n_indices) == (10, 200, 300) and plain[1612].sum_feature_id == 45
    assert plain[1613].n_buildings == 0 and plain[1613].low is None and plain[1612].low[1] == 0 and plain[1612].high[1] == 19
    few = {r.tile.y: r for r in glb.contents(engine.render_tiles(table, zoom=12, mode="replace")).collect()}
    assert few[1613].n_buildings == 1 and few[1612].n_vertices == 200 and 0 < few[1612].n_indices <= 300


def test_glb_container() -> None:
    empty = glb.pack(np.zeros((0, 3)), np.zeros((0, 3)), np.zeros(0), np.zeros(0), {}, [1.0] * 16)
    assert empty[:4] == b"glTF" and len(empty) > 20 and struct.unpack("<I", empty[8:12])[0] == len(empty)
    table = {k: [1] for k in glb.NUMBERS} | {k: ["é"] for k in glb.TEXTS}
    out = glb.pack(np.eye(3), np.eye(3), np.zeros(3), np.arange(3), table, [1.0] * 16, "me")
    size = struct.unpack("<I", out[12:16])[0]
    doc = json.loads(out[20 : 20 + size])
    assert len(out) % 4 == 0 and doc["accessors"][0]["max"] == [1, 1, 1] and doc["asset"]["copyright"] == "me"
    props = doc["extensions"]["EXT_structural_metadata"]["propertyTables"][0]["properties"]
    assert len(props) == 13 and all(v["byteOffset"] % (8 if i >= 4 and i < 11 else 2) == 0 for i, v in enumerate(doc["bufferViews"]))


def test_manifest(spark: SparkSession, tmp_path: Path) -> None:
    import hashlib

    sha = lambda b, n: hashlib.sha1(b).hexdigest()[: 2 * n]
    tiles = spark.createDataFrame([(14, 1, 2, None), (14, 1, 3, b"land")], "z int, x int, y int, terrain binary")
    sources = tiles.select(F.col("z").alias("out_z"), F.col("x").alias("out_x"), F.col("y").alias("out_y"), "z", "x", "y", F.lit(b"abc").alias("content"), F.lit(0).alias("position"))
    got = {r.y: r.hash for r in manifest.content_hash(tiles, sources, (5.0, 2000.0)).collect()}
    for y, t in ((2, "no-terrain"), (3, sha(b"land", 12))):
        assert got[y] == sha(f"14/1/{y};f=5,2000;s=1,0;a=0;t={t};n=1;14/1/{y}:{sha(b'abc', 16)};".encode(), 12)
    hashes = manifest.content_hash(tiles, sources, (5.0, 2000.0))
    assert manifest.pending(hashes, hashes.where("y = 2").withColumn("impl", F.lit("v1")), "v1").select("y").collect()[0][0] == 3
    manifest.write_outputs(hashes.withColumn("glb", F.lit(b"x")), f"{tmp_path}/out", "v1")
    assert spark.read.parquet(f"{tmp_path}/out").where("impl = 'v1'").count() == 2


def test_stream_renders_each_content_once(spark: SparkSession, tmp_path: Path) -> None:
    tile = encode_tile([{"id": i, "rings": [[(x // 5 + 200 * i, y // 5) for x, y in SQUARE]], "height": 10.0} for i in range(3)])
    rows = lambda *ys: spark.createDataFrame([(14, 14552, y, tile) for y in ys], rerender.TILES)
    go = lambda: rerender.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", "v1").awaitTermination()
    rows(6451, 6452).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    assert spark.read.parquet(f"{tmp_path}/out/buildings").count() == 6
    rows(6452, 6453).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    assert spark.read.parquet(f"{tmp_path}/out/buildings").count() == 9 and spark.read.parquet(f"{tmp_path}/out/manifest").count() == 3
    spark.createDataFrame([(14, 14552, 6451, encode_tile([{"id": 7, "rings": [[(x // 5, y // 5) for x, y in SQUARE]], "height": 3.0}]))], rerender.TILES).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    assert spark.read.parquet(f"{tmp_path}/out/buildings").count() == 10
    now = rerender.current(spark, f"{tmp_path}/out", "v1").collect()
    assert len(now) == 7 and [int(r.feature_id) for r in now if r.y == 6451] == [7]
