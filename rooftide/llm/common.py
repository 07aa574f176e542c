"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word rule of the corpus contracts: maximal runs of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: Lower-cases A-Z only, as the corpus contracts ask.
LOWER_ASCII = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Lets a query remove its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tidy() -> None:
    """Give back what a worker no longer uses: workers are kept for later tasks, whose memory adds up in an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def arrow(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that tidies up at the end of its task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; unnamed columns are never read."""
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it yields any number of batches of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(arrow(run), schema)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one binary or string column stays near ``most_bytes`` per piece."""
    start, total = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most_rows: int, most_bytes: int = 32 << 20) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` in tables that hold all rows of their keys; each is cut near ``most_rows`` and ``most_bytes`` where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for part in (batch.slice(a, most_rows) for a in range(0, batch.num_rows, most_rows)):
            held.append(part)
            if sum(x.num_rows for x in held) >= most_rows or sum(x.nbytes for x in held) >= most_bytes:
                whole = pa.Table.from_batches(held)
                last = whole.column(key)[whole.num_rows - 1]
                end = int(pc.index(whole.column(key), last).as_py())
                if end > 0:
                    yield whole.slice(0, end)
                    held = whole.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> SparkSession:
    """Let Python functions of this session take Arrow batches of at most so many bytes, if they may take more.

    Each task holds a few batches in the executor's memory and in Python's; 64 MB, Spark's own bound, is meant for larger ones.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) > most_bytes:
        spark.conf.set(name, str(most_bytes))
    return spark


def crc_remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string")) % n


def held_out(key: Column, n: int) -> Column:
    """True where :func:`crc_remainder` is 2; false for a null key."""
    return F.coalesce(crc_remainder(key, n) == 2, F.lit(False))


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs no rerun.

    With ``release`` the shuffles that this takes go as soon as it is written, not when the driver happens to collect its
    garbage. Spark before 4.1 does not know the setting and keeps them.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    if not release:
        return df.checkpoint(eager=True)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting when it is made
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; only a local session may do without it."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="rooftide-")
