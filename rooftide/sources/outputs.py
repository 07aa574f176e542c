"""A sink of content-addressed tile outputs with a commit protocol.

    spark.dataSource.register(TileOutputs)
    rows.write.format("tile_outputs").option("path", p).option("impl", "v1").mode("append").save()

Rows are (z, x, y, hash, glb).  A task writes each output that isn't there yet
under a name of its own job, ``{impl}/.{job}.{hash}``, and gives it its name
``{impl}/{hash}.glb`` when all its rows are written; then it writes one file of
manifest rows aside.  The job's commit moves those files, one for each task, to
``manifest/impl={impl}``: an output counts once its manifest row is there.  A
failed task takes its own files away, and a job that fails those of its other
tasks.  Names are hashes of what the outputs are made of, so a task that runs
again, or a second run, finds them there and writes nothing.  Paths are local or those
of any file system that Arrow can open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = pa.schema([("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("hash", pa.string()), ("n_bytes", pa.int64()), ("fresh", pa.bool_())])


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Where a task has put its manifest rows; none if it had no rows."""

    part: str | None


class OutputWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.impl, self.job = options["path"], options["impl"], uuid.uuid4().hex

    def _is_file(self, store: fs.FileSystem, name: str) -> bool:
        return store.get_file_info(name).type == fs.FileType.File

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, base = place(self.path)
        folder, rows, fresh = f"{base}/{self.impl}", [], []
        store.create_dir(folder, recursive=True)
        own = f".{self.job}.{uuid.uuid4().hex[:8]}"
        try:
            for r in iterator:
                new = not self._is_file(store, f"{folder}/{r.hash}.glb")
                if new:
                    with store.open_output_stream(f"{folder}/{own}.{r.hash}") as f:
                        f.write(bytes(r.glb))
                    fresh.append(r.hash)
                rows.append((r.z, r.x, r.y, r.hash, len(r.glb), new))
            if not rows:
                return Written(None)
            part = f"{base}/staged/{self.job}/{uuid.uuid4().hex}.parquet"
            store.create_dir(part.rpartition("/")[0], recursive=True)
            columns = list(zip(*rows, strict=True))
            with store.open_output_stream(part) as f:  # before the names are given: whoever undoes the job finds them here
                pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types, strict=True)], schema=SCHEMA), f)
            for name in dict.fromkeys(fresh):
                store.move(f"{folder}/{own}.{name}", f"{folder}/{name}.glb")
            return Written(part)
        except BaseException:
            for name in dict.fromkeys(fresh):
                if self._is_file(store, f"{folder}/{own}.{name}"):
                    store.delete_file(f"{folder}/{own}.{name}")
            raise

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = place(self.path)
        folder = f"{base}/manifest/impl={self.impl}"
        store.create_dir(folder, recursive=True)
        for m in messages:
            if isinstance(m, Written) and m.part:
                store.move(m.part, f"{folder}/{m.part.rpartition('/')[2]}")
        self._clear(store, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Takes away what the job's tasks have written, finished or not."""
        store, base = place(self.path)
        staged = fs.FileSelector(f"{base}/staged/{self.job}", allow_not_found=True)
        for info in store.get_file_info(staged):
            with store.open_input_file(info.path) as f:
                found = pq.read_table(f, columns=["hash", "fresh"]).to_pylist()
            for name in {r["hash"] for r in found if r["fresh"]}:
                if self._is_file(store, f"{base}/{self.impl}/{name}.glb"):
                    store.delete_file(f"{base}/{self.impl}/{name}.glb")
        for info in store.get_file_info(fs.FileSelector(f"{base}/{self.impl}", allow_not_found=True)):
            if info.base_name.startswith(f".{self.job}."):  # of executors that were lost
                store.delete_file(info.path)
        self._clear(store, base)

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/staged/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/staged/{self.job}")


class TileOutputs(DataSource):
    """Options: ``path`` and ``impl``, the name of the implementation that made the outputs."""

    @classmethod
    def name(cls) -> str:
        return "tile_outputs"

    def schema(self) -> str:
        return "z int, x int, y int, hash string, glb binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("outputs are named by their content: append to them")
        return OutputWriter(dict(self.options))


def write(rendered: DataFrame, path: str, impl: str) -> None:
    """(z, x, y, hash, glb) rows as files with their manifest."""
    spark = rendered.sparkSession
    spark.dataSource.register(TileOutputs)
    rendered.select("z", "x", "y", "hash", "glb").write.format("tile_outputs").option("path", path).option("impl", impl).mode("append").save()


def manifest(rendered: DataFrame, path: str) -> DataFrame:
    """(z, x, y, hash, n_bytes, impl) of all outputs that count; each once, however often it was written."""
    spark = rendered.sparkSession
    store, base = place(path)
    schema = "z int, x int, y int, hash string, n_bytes bigint, impl string"
    if store.get_file_info(f"{base}/manifest").type != fs.FileType.Directory:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/manifest").dropDuplicates(["z", "x", "y", "hash", "impl"])
