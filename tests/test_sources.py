"""Filters and joined reads of archives; the commit protocol of outputs."""

from __future__ import annotations

import re
import time
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from test_tiles import SQUARE, build_archive

from rooftide.functions import scalars
from rooftide.plans.bindings import encode_tile
from rooftide.sources import archive, outputs, truth, vector_tiles
from rooftide.streaming import rerender

TILES = {(5, x, y): f"{x}/{y} ".encode() * (1 + x % 3) for x in range(32) for y in range(32) if (x * 5 + y) % 4}


def rows_of(reader: archive.TileReader) -> list[tuple]:
    return sorted(r for p in reader.partitions() for r in reader.read(p))


@pytest.mark.parametrize("few", [4096, 1])
def test_filters_narrow_what_is_read(tmp_path: Path, few: int, monkeypatch: pytest.MonkeyPatch) -> None:
    place = tmp_path / "a.pmtiles"
    place.write_bytes(build_archive(TILES, 40))
    monkeypatch.setattr(archive, "FEW", few)
    a = archive
    cases = [
        ([a.EqualTo(("z",), 5), a.GreaterThan(("x",), 3), a.LessThanOrEqual(("x",), 9), a.EqualTo(("y",), 7)], lambda x, y: 3 < x <= 9 and y == 7, 0),
        ([a.GreaterThanOrEqual(("y",), 30), a.LessThan(("x",), 2), a.IsNotNull(("x",))], lambda x, y: y >= 30 and x < 2, 0),
        ([a.EqualTo(("z",), 4)], lambda x, y: False, 0),
        ([a.GreaterThan(("x",), 40)], lambda x, y: False, 0),
        ([a.EqualTo(("content",), b"x"), a.GreaterThan(("z",), 1), a.EqualTo(("x",), None)], lambda x, y: True, 3),
    ]
    for filters, want, left in cases:
        reader = archive.FilteringReader({"path": str(place), "z": "5"})
        assert len(list(reader.pushFilters(filters))) == left
        assert rows_of(reader) == sorted((*k, v) for k, v in TILES.items() if want(k[1], k[2]))


def test_neighbours_come_in_one_read(tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    place = tmp_path / "b.pmtiles"
    place.write_bytes(build_archive(TILES, 0))
    known = archive.opened(str(place))
    reads: list[int] = []
    plain = known.bytes
    monkeypatch.setattr(known, "bytes", lambda at, size: (reads.append(size), plain(at, size))[1])
    reader = archive.TileReader({"path": str(place), "z": "5", "west": "-179", "east": "0", "south": "1", "north": "85"})
    found = rows_of(reader)
    assert len(found) > 150 and len(reads) <= 2  # a quarter of the square is one run of the curve
    reads.clear()
    monkeypatch.setattr(archive, "GAP", 0)
    monkeypatch.setattr(archive, "MOST_READ", 64)
    assert rows_of(reader) == found and len(reads) > 20 and max(reads) <= 64


def test_the_plan_leaves_pushed_filters_to_the_source(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "c.pmtiles").write_bytes(build_archive(TILES))
    assert archive.read(spark, f"{tmp_path}/c.pmtiles", 5).where("x = 9 and y = 4").count() == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = archive.read(spark, f"{tmp_path}/c.pmtiles", 5).where("x = 9 and y between 3 and 6")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan tile_archive" in plan and not re.search(r"\bFilter\b", plan)  # the source takes all of it
        kept = found.where("content is not null and length(content) > 6")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"\bFilter .*length", kept)
        assert {(r.x, r.y) for r in found.collect()} == {k[1:] for k in TILES if k[1] == 9 and 3 <= k[2] <= 6}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def listed(path: Path) -> list[str]:
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_outputs_are_committed_once(spark: SparkSession, tmp_path: Path) -> None:
    out = tmp_path / "out"
    rows = spark.range(40).select(F.lit(14).alias("z"), F.col("id").cast("int").alias("x"), F.lit(1).alias("y"), F.sha1(F.col("id").cast("string").cast("binary")).alias("hash"), F.concat(F.lit("glb "), F.col("id").cast("string")).cast("binary").alias("glb")).repartition(4)
    assert outputs.manifest(rows, str(out)).count() == 0
    outputs.write(rows.where("x < 25"), str(out), "v1")
    first = {n: (out / n).stat().st_mtime_ns for n in listed(out) if n.endswith(".glb")}
    assert len(first) == 25 and outputs.manifest(rows, str(out)).count() == 25
    outputs.write(rows, str(out), "v1")
    names = [n for n in listed(out) if n.endswith(".glb")]
    assert len(names) == 40 and all((out / n).stat().st_mtime_ns == t for n, t in first.items())
    assert outputs.manifest(rows, str(out)).count() == 40 and not any("staged" in n or "/." in n for n in listed(out))
    with pytest.raises(Exception, match="append"):
        rows.write.format("tile_outputs").option("path", str(out)).option("impl", "v1").mode("overwrite").save()


def test_a_failed_job_leaves_nothing(spark: SparkSession, tmp_path: Path) -> None:
    out = tmp_path / "out"
    rows = spark.range(40).select(F.lit(14).alias("z"), F.col("id").cast("int").alias("x"), F.lit(1).alias("y"), F.sha1(F.col("id").cast("string").cast("binary")).alias("hash"), F.lit(b"x").alias("glb")).repartitionByRange(4, "x")
    outputs.write(rows.where("x < 5"), str(out), "v1")
    before = listed(out)
    broken = rows.withColumn("glb", F.when(F.col("x") == 37, F.raise_error(F.lit("a task fails")).cast("binary")).otherwise(F.col("glb")))
    with pytest.raises(Exception, match="fails"):
        outputs.write(broken, str(out), "v1")
    assert listed(out) == before
    writer = outputs.OutputWriter({"path": str(out), "impl": "v1"})
    done = writer.write(iter(rows.where("x = 30").collect()))
    (out / "v1" / f".{writer.job}.lost.name").write_bytes(b"of an executor that was lost")
    assert len(listed(out)) == len(before) + 3
    writer.abort([done, None])
    assert listed(out) == before
    outputs.write(rows, str(out), "v1")
    assert outputs.manifest(rows, str(out)).count() == 40


def test_the_stream_writes_each_tile_once(spark: SparkSession, tmp_path: Path) -> None:
    tile = encode_tile([{"id": i, "rings": [[(x // 5 + 200 * i, y // 5) for x, y in SQUARE]], "height": 10.0} for i in range(3)])
    go = lambda: rerender.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", "v1", glb=True).awaitTermination()
    for ys in ((6451, 6452), (6452, 6453)):
        spark.createDataFrame([(14, 14552, y, tile) for y in ys], rerender.TILES).write.mode("append").parquet(f"{tmp_path}/in")
        go()
    found = outputs.manifest(spark.range(1), f"{tmp_path}/out/tiles").collect()
    assert sorted(r.y for r in found) == [6451, 6452, 6453]
    names = list((tmp_path / "out/tiles/v1").glob("*.glb"))
    assert {p.stem for p in names} == {r.hash for r in found} and all(p.read_bytes()[:4] == b"glTF" for p in names)


def damaged_tiles(spark: SparkSession):
    good = encode_tile([{"id": k, "rings": [SQUARE], "height": 1.0 * k} for k in range(3)])
    rows = [(14, 1, 0, good), (14, 1, 1, good[:-4]), (14, 1, 2, b""), (14, 1, 3, None), (14, 1, 4, b"\x1f\x8bnot gzip"), (14, 1, 5, good), (14, 1, 6, encode_tile([{"id": 9, "rings": [SQUARE]}], layer="roads"))]
    return spark.createDataFrame(rows, rerender.TILES).repartition(3)


def test_damaged_tiles_are_kept_aside(spark: SparkSession, tmp_path: Path) -> None:
    tiles = damaged_tiles(spark)
    found = vector_tiles.land(tiles, f"{tmp_path}/landed")
    assert found.counts == {"tiles": 7, "features": 6, "damaged": 2, "empty": 3}
    bad = {r.y: r for r in found.damaged.collect()}
    assert sorted(bad) == [1, 4] and all(r.error for r in bad.values()) and bytes(bad[4].content) == b"\x1f\x8bnot gzip"
    plain = vector_tiles.read_tiles(tiles)
    assert found.features.columns == plain.columns and sorted(map(str, found.features.collect())) == sorted(map(str, plain.collect()))
    # the tiles that were put aside can be read again once they are mended
    again = vector_tiles.land(found.damaged.withColumn("content", F.lit(encode_tile([{"id": 1, "rings": [SQUARE]}]))), f"{tmp_path}/again")
    assert again.counts == {"tiles": 2, "features": 2, "damaged": 0, "empty": 0} and again.damaged.count() == 0
    assert vector_tiles.land(tiles.limit(0), f"{tmp_path}/none").counts == {"tiles": 0, "features": 0, "damaged": 0, "empty": 0}


def test_a_stream_counts_its_tiles(spark: SparkSession, tmp_path: Path) -> None:
    damaged_tiles(spark).write.parquet(f"{tmp_path}/in")
    listener = vector_tiles.TileCounts()
    spark.streams.addListener(listener)
    try:
        rows = vector_tiles.watched(vector_tiles.read_tiles(spark.readStream.schema(rerender.TILES).parquet(f"{tmp_path}/in"), mode="QUARANTINE"))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(50):
            if listener.counts:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.counts == {"tiles": 7, "features": 6, "damaged": 2, "empty": 3}


def test_heights_as_text_round_ties_to_the_even_digit(spark: SparkSession) -> None:
    values = [52.625, 52.375, 0.145, 2.675, 1234567.125, -0.001, 0.0, 3.0, 1e16]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.fixed(F.col("v"), 2).alias("s")).collect()
    assert {r.v: r.s for r in rows} == {v: f"{v:.2f}" for v in values}
    odd = spark.createDataFrame([(float("inf"),), (None,)], "v double").select(scalars.fixed(F.col("v"), 2)).collect()
    assert [r[0] for r in odd] == ["Infinity", None]
    line = truth.csv_lines(spark.createDataFrame([(139.5, 35.25, 52.625)], "lon double, lat double, measured_height_m float")).first()[0]
    assert line == "139.5000000,35.2500000,52.62"
