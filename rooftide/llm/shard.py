"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters rows by a seeded hash into buckets that fit a task's memory.
Pass two holds one bucket at a time, puts its rows in a fixed order, applies a
Fisher-Yates permutation whose draws are seeded hashes of (bucket, step), and
deals the result out.  All buckets end to end are one random order of the whole
table; row g of it goes to shard g mod n at slot g div n, so shard sizes differ
by one row at most and slots have no gaps.  Under this law equal texts are not
kept together: each copy has a place of its own, as any other row.

Every step is a function of the rows and the seed, so a task that runs again
after an executor is lost gives the same result.

Cases: a null key or text is a value like any other; empty and very long texts
are rows like any other (a row larger than a bucket is a bucket's worth by
itself); equal rows are interchangeable, and where their copies would fill an
eighth of a bucket, in rows or bytes, each copy is scattered by a number of its
own; an empty table gives an empty result; input columns named ``shard`` or
``slot`` are replaced, all others are kept, whatever their names; columns that
have no order (maps) raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import cut

#: Text bytes and rows of a bucket: a task holds a few copies of one bucket.  Each step of the permutation copies it (Spark's
#: arrays can't be changed in place), which is quadratic in the rows of a bucket; so short rows get more buckets, not larger ones.
BUCKET_BYTES, BUCKET_ROWS = 8 << 20, 256
#: Hashes (8 bytes each) of much repeated rows up to which they are broadcast.
BROADCAST_HASHES = 500_000
#: Buckets whose offsets one task finds; it then takes one task for the runs, of which there are so many times fewer.
RUN = 4096


def fisher_yates(n: Column, bucket: Column, seed: int) -> Column:
    """A permutation of 0..n-1 as an array: element i takes the place of a drawn earlier one, which moves to the end."""

    def step(done: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        moved = F.concat(F.slice(done, F.lit(1), j), F.array(i), F.slice(done, j + 2, i - j - 1), F.array(F.get(done, j)))
        return F.when(j == i, F.concat(done, F.array(i))).otherwise(moved)

    numbers = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, F.array().cast("array<int>"), step)


def external_shuffle(df: DataFrame, shards: int, seed: int = 9, payload: str = "text", bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to shards-1) and ``slot`` (from 0 in each shard).

    ``payload`` names the column that makes up a row's size.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    if bad := [c for c in kept if isinstance(df.schema[c].dataType, MapType | VariantType)]:
        raise ValueError(f"columns without an order: {bad}")
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(payload)), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes), -(-rows // bucket_rows))
    df = df.select(F.struct(*kept).alias("row"), F.xxhash64(*kept).alias("h"), F.coalesce(F.octet_length(payload), F.lit(0)).alias("size"))
    # copies of a row are hot where they would fill an eighth of a bucket
    counted = df.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    hot = cut(counted.where((F.col("n") > 1) & ((F.col("n") > bucket_rows // 8) | (F.col("n") * F.col("size") > bucket_bytes // 8))).select("h"))
    numbered = df.select("row", F.lit(0).alias("ordinal"))
    if most := hot.count():  # count them, and give each copy a place of its own
        hot = F.broadcast(hot) if most <= BROADCAST_HASHES else hot
        copies = df.join(hot, "h", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.first("h").alias("h"), F.first("size").alias("size"))
        # numbered in runs of a bucket's worth, which are dealt over all tasks before copies are made
        run = F.least(F.lit(bucket_rows), F.greatest(F.lit(1), F.floor(F.lit(bucket_bytes) / F.greatest(F.col("size"), F.lit(1)))))
        runs = copies.withColumn("long", run).select("row", "h", "n", "long", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("long")))).alias("run"))
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        runs = runs.repartition(tasks, "h", "run")
        start = F.col("run") * F.col("long")
        copies = runs.select("row", F.explode(F.sequence(start + 1, F.least(F.col("n"), start + F.col("long")))).alias("ordinal")).select("row", F.col("ordinal").cast("int"))
        numbered = df.join(hot, "h", "left_anti").select("row", F.lit(0).alias("ordinal")).unionByName(copies)
    values = [F.col(f"row.`{c}`") for c in kept]
    place = F.pmod(F.xxhash64(F.lit(seed), "ordinal", *values), F.lit(buckets)).cast("int")
    scattered = numbered.select(place.alias("bucket"), F.struct(F.xxhash64(F.lit(~seed), "ordinal", *values).alias("h"), "row").alias("row"))
    counts = cut(numbered.select(place.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    held = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("row")).alias("rows")).join(offsets(counts), "bucket")
    order = fisher_yates(F.size("rows"), F.col("bucket"), seed)
    dealt = held.select("offset", F.transform(order, lambda k: F.get(F.col("rows"), k)).alias("rows"))
    flat = dealt.select("offset", F.posexplode("rows").alias("at", "row"))
    place = F.col("offset") + F.col("at")
    return flat.select(*[F.col(f"row.row.`{c}`").alias(c) for c in kept], F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def offsets(counts: DataFrame) -> DataFrame:
    """(bucket, offset): rows in the buckets before, summed in runs of RUN buckets first."""
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    starts = runs.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(before.orderBy("run")), F.lit(0)).alias("start"))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("run").orderBy("bucket")), F.lit(0))
    return runs.select("bucket", "run", inner.alias("inner")).join(starts, "run").select("bucket", (F.col("start") + F.col("inner")).alias("offset"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
