"""Content hashes of tiles and incremental materialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sha1_prefix

SOURCE_BYTES, TERRAIN_BYTES, HASH_BYTES = 16, 12, 12


def number(v: float) -> str:
    """Whole numbers without a fraction."""
    return str(int(v)) if float(v).is_integer() else repr(float(v))


def header(z: Column, x: Column, y: Column, area: tuple[float, float], simplify: tuple[float, float], boxes: bool, terrain: Column, n_sources: Column) -> Column:
    f, s = (",".join(map(number, v)) for v in (area, simplify))
    tag = F.coalesce(sha1_prefix(terrain, TERRAIN_BYTES), F.lit("no-terrain"))
    return F.concat(F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string")), F.lit(f";f={f};s={s};a={int(boxes)};t="), tag, F.lit(";n="), n_sources.cast("string"), F.lit(";"))


def content_hash(tiles: DataFrame, sources: DataFrame, area: tuple[float, float], simplify: tuple[float, float] = (1.0, 0.0), boxes: bool = False) -> DataFrame:
    """(z, x, y, hash) of output tiles (with ``terrain`` binary, may be null) from their sources.

    ``sources`` has out_z, out_x, out_y, z, x, y, ``content`` and ``position`` (their order).
    """
    one = F.concat(F.concat_ws("/", F.col("z").cast("string"), F.col("x").cast("string"), F.col("y").cast("string")), F.lit(":"), sha1_prefix(F.col("content"), SOURCE_BYTES), F.lit(";"))
    listed = sources.select(F.col("out_z").alias("z_"), F.col("out_x").alias("x_"), F.col("out_y").alias("y_"), F.struct("position", one.alias("s")).alias("e")).groupBy("z_", "x_", "y_").agg(F.sort_array(F.collect_list("e")).alias("e"))
    joined = tiles.join(listed, (F.col("z") == F.col("z_")) & (F.col("x") == F.col("x_")) & (F.col("y") == F.col("y_")), "left")
    head = header(F.col("z"), F.col("x"), F.col("y"), area, simplify, boxes, F.col("terrain"), F.coalesce(F.size("e"), F.lit(0)))
    tail = F.coalesce(F.concat_ws("", F.transform("e", lambda e: e["s"])), F.lit(""))
    return joined.select("z", "x", "y", sha1_prefix(F.concat(head, tail), HASH_BYTES).alias("hash"))


def pending(hashes: DataFrame, manifest: DataFrame, impl: str) -> DataFrame:
    """The tiles whose output isn't there yet: anti-join on the implementation and the hash."""
    done = manifest.where(F.col("impl") == impl).select("hash")
    return hashes.join(done, "hash", "left_anti")


#: Seconds that a cache may keep a document, by kind; pyramid documents below the root never change.
KEEP_S = {"glb": 300, "root": 60, "sub": 2_592_000}
RETRY_S = 2


def response(outputs: DataFrame, enabled: bool = True, kind: str = "kind", failed: str = "failed") -> DataFrame:
    """``outputs`` (with ``hash``, a ``kind`` of :data:`KEEP_S` and ``failed``) with ``status``, ``etag``, ``cache_control`` and ``retry_after``.

    A failed output may be asked for again soon; nothing is kept of it, nor of any where caching is off.
    """
    lost = F.coalesce(F.col(failed), F.lit(False))
    age = F.concat(F.lit("public, max-age="), F.get(F.lit(list(KEEP_S.values())), F.array_position(F.lit(list(KEEP_S)), F.col(kind)).cast("int") - 1).cast("string"), F.when(F.col(kind) == "sub", ", immutable").otherwise(""))
    keep = F.when(~lost & F.lit(enabled), age).otherwise("no-store")
    return outputs.withColumns({
        "status": F.when(lost, 503).otherwise(200),
        "etag": F.when(~lost, F.concat(F.lit('"'), F.col("hash"), F.lit('"'))),
        "cache_control": keep,
        "retry_after": F.when(lost, RETRY_S),
    })


def write_outputs(rendered: DataFrame, path: str, impl: str, mode: str = "append") -> None:
    """(z, x, y, hash, glb) rows under the implementation's partition; ``overwrite`` regenerates."""
    rows = rendered.withColumn("impl", F.lit(impl)).withColumn("etag", F.concat(F.lit('"'), F.col("hash"), F.lit('"')))
    rows.write.mode(mode).partitionBy("impl").parquet(path)
