"""A data source for single-file tile pyramids (PMTiles version 3) read by ranges.

    spark.dataSource.register(TileArchive)
    spark.read.format("tile_archive").option("path", p).option("z", 14).option("west", ...).load()

Paths are local ones or those of any file system that Arrow can open (s3, gs,
hdfs), and http addresses; a read that fails is tried again.  The header and
directories are read once per worker and path, and each partition reads the byte
ranges of its own tiles only.  A small box asks for its addresses one by one; a
large one walks the entries of the directories.  Options: ``z``, the box
(``west``, ``south``, ``east``, ``north``), or one tile (``x``, ``y``).  With
``filters`` set to ``push``, for which the session must push filters to Python
sources (``spark.sql.python.filterPushdown.enabled``; :func:`read` looks for
it), comparisons of ``z``, ``x`` and ``y`` with constants narrow what is read.  A partition's tiles are neighbours on
the Hilbert curve, in whose order an archive holds them, and those that lie side
by side come in one read.
"""

from __future__ import annotations

import gzip
import math
import struct
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .vector_tiles import varint

HEADER = 127
#: Addresses of a box up to which they are asked for one by one; entries of a directory that make a partition.
FEW, ENTRIES = 4096, 512
#: Tiles of a partition of a small box; bytes between tiles that are read along with them, and the largest read.
NEIGHBOURS, GAP, MOST_READ = 256, 65_536, 16 << 20
ATTEMPTS, WAIT_S, TIMEOUT_S = 4, 0.5, 60
_KNOWN: dict[str, Archive] = {}


def tile_number(z: int, x: int, y: int) -> int:
    """Position of a tile on the Hilbert curve over all zooms."""
    out, n = ((1 << 2 * z) - 1) // 3, 1 << z
    s, tx, ty = n >> 1, x, y
    while s:
        rx, ry = int(bool(tx & s)), int(bool(ty & s))
        out += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                tx, ty = s - 1 - tx & (n - 1), s - 1 - ty & (n - 1)
            tx, ty = ty, tx
        s >>= 1
    return out


def tile_address(number: int) -> tuple[int, int, int]:
    """The tile at a position: the way back of :func:`tile_number`."""
    z = 0
    while number >= ((1 << 2 * (z + 1)) - 1) // 3:
        z += 1
    rest = number - ((1 << 2 * z) - 1) // 3
    x = y = 0
    for k in range(z):
        s = 1 << k
        rx = rest >> 1 & 1
        ry = (rest ^ rx) & 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, rest = x + s * rx, y + s * ry, rest >> 2
    return z, x, y


def again(read: Callable[[], bytes], attempts: int = ATTEMPTS, wait: float = WAIT_S) -> bytes:
    """A read with further attempts after longer and longer waits; refusals of the request itself are final."""
    for k in range(1, attempts + 1):
        try:
            return read()
        except urllib.error.HTTPError as e:
            if k == attempts or e.code < 500 and e.code not in (408, 425, 429):
                raise
        except (OSError, TimeoutError):
            if k == attempts:
                raise
        time.sleep(wait * 2**k)
    raise AssertionError


def ranged(path: str) -> Callable[[int, int], bytes]:
    """A function that reads (offset, size) of a file, wherever it is."""
    if path.startswith(("http://", "https://")):

        def fetch(at: int, size: int) -> bytes:
            request = urllib.request.Request(path, headers={"Range": f"bytes={at}-{at + size - 1}"})
            with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
                data = answer.read(at + size if answer.status == 200 else size)
            return data[at : at + size] if answer.status == 200 else data

        return lambda at, size: again(lambda: fetch(at, size))
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def read(at: int, size: int) -> bytes:
        with store.open_input_file(name) as f:
            return f.read_at(min(size, f.size() - at), at)

    return read if isinstance(store, fs.LocalFileSystem) else lambda at, size: again(lambda: read(at, size))


def directory(data: bytes) -> list[tuple[int, int, int, int]]:
    """(tile number, run length, length, offset) entries."""
    at, columns = 0, []
    n, at = varint(data, at)
    for _ in range(4):
        values = []
        for _ in range(n):
            v, at = varint(data, at)
            values.append(v)
        columns.append(values)
    numbers, runs, lengths, offsets = columns
    out, number = [], 0
    for i in range(n):
        number += numbers[i]
        offset = out[-1][3] + out[-1][2] if offsets[i] == 0 and i else offsets[i] - 1
        out.append((number, runs[i], lengths[i], offset))
    return out


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


#: Compression of directories: none, gzip, zstandard.
UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 2: gzip.decompress, 4: _zstd}


class Archive:
    """Header and directories of one file."""

    def __init__(self, path: str) -> None:
        self.bytes = ranged(path)
        head = self.bytes(0, HEADER)
        if head[:7] != b"PMTiles" or head[7] != 3:
            raise ValueError("not a PMTiles 3 archive")
        self.root_at, self.root_size, _, _, self.leaf_at, _, self.data_at, _ = struct.unpack_from("<8Q", head, 8)
        if head[97] not in UNPACK:
            raise ValueError(f"directories in compression {head[97]} can't be read here")
        self.unpack = UNPACK[head[97]]
        self.root = self.directory(self.root_at, self.root_size)
        self.leaves: dict[int, list[tuple[int, int, int, int]]] = {}

    def directory(self, at: int, size: int) -> list[tuple[int, int, int, int]]:
        return directory(self.unpack(self.bytes(at, size)))

    def walk(self, entries: list[tuple[int, int, int, int]], first: int, end: int, after: int | None = None) -> Iterator[tuple[int, int, int]]:
        """(tile number, offset, length) of all tiles with numbers in [first, end) below some entries; ``after`` is where the last one's tiles end."""
        for k, (number, run, size, offset) in enumerate(entries):
            stop = entries[k + 1][0] if k + 1 < len(entries) else after
            if number >= end or (stop is not None and stop <= first):
                continue
            if not run:
                yield from self.walk(self.directory(self.leaf_at + offset, size), first, end, stop)
            for n in range(max(number, first), min(number + run, end)):
                yield n, offset, size

    def find(self, number: int) -> tuple[int, int] | None:
        """(offset, size) of a tile's bytes."""
        entries = self.root
        for _ in range(4):
            low, high = 0, len(entries)
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if entries[mid][0] <= number else (low, mid)
            if not low:
                return None
            first, run, size, offset = entries[low - 1]
            if run:
                return (offset, size) if number < first + run else None
            if offset not in self.leaves:
                self.leaves[offset] = self.directory(self.leaf_at + offset, size)
            entries = self.leaves[offset]
        return None

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        found = self.find(tile_number(z, x, y))
        return self.bytes(self.data_at + found[0], found[1]) if found else None

    def contents(self, places: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, bytes]]:
        """(tile number, bytes) of (tile number, offset, size); tiles side by side in the file come in one read."""
        held: list[tuple[int, int, int]] = []

        def read() -> Iterator[tuple[int, bytes]]:
            start, stop = min(o for _, o, _ in held), max(o + n for _, o, n in held)
            data = self.bytes(self.data_at + start, stop - start)
            for number, offset, size in held:
                yield number, data[offset - start : offset - start + size]

        for number, offset, size in places:
            if not size:
                continue
            if held:
                start, stop = min(o for _, o, _ in held), max(o + n for _, o, n in held)
                if offset > stop + GAP or offset + size < start - GAP or max(stop, offset + size) - min(start, offset) > MOST_READ or len(held) >= NEIGHBOURS:
                    yield from read()
                    held = []
            held.append((number, offset, size))
        if held:
            yield from read()


def opened(path: str) -> Archive:
    """One archive per worker and path; only a good header is kept."""
    if path not in _KNOWN:
        _KNOWN[path] = Archive(path)
    return _KNOWN[path]


class Numbers(InputPartition):
    """Tiles by their numbers, in the order of the curve."""

    def __init__(self, numbers: list[int]) -> None:
        self.numbers = numbers


class Entries(InputPartition):
    """Entries of the root directory, and where the tiles of the last one end."""

    def __init__(self, entries: list[tuple[int, int, int, int]], after: int | None) -> None:
        self.entries, self.after = entries, after


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.z = options["path"], int(options.get("z", "14"))
        n, box = 1 << self.z, [float(options.get(k, d)) for k, d in (("west", "-180"), ("south", "-85.0511"), ("east", "180"), ("north", "85.0511"))]
        clamp = lambda v: min(max(math.floor(v), 0), n - 1)
        row = lambda lat: (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n
        self.x0, self.x1 = clamp((box[0] + 180) / 360 * n), clamp((box[2] + 180) / 360 * n)
        self.y0, self.y1 = clamp(row(box[3])), clamp(row(box[1]))
        if "x" in options:
            self.x0 = self.x1 = int(options["x"])
        if "y" in options:
            self.y0 = self.y1 = int(options["y"])
        self.nothing = False

    def partitions(self) -> list[InputPartition]:
        if self.nothing:
            return [Numbers([])]
        if (self.x1 - self.x0 + 1) * (self.y1 - self.y0 + 1) <= FEW:
            numbers = sorted(tile_number(self.z, x, y) for x in range(self.x0, self.x1 + 1) for y in range(self.y0, self.y1 + 1))
            return [Numbers(numbers[a : a + NEIGHBOURS]) for a in range(0, len(numbers), NEIGHBOURS)]
        root = opened(self.path).root
        starts = range(0, len(root), ENTRIES if any(e[1] for e in root) else 1)  # a leaf directory is a partition of its own
        step = starts.step
        return [Entries(root[a : a + step], root[a + step][0] if a + step < len(root) else None) for a in starts]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, int, int, bytes]]:
        archive = opened(self.path)
        if isinstance(partition, Numbers):
            places = ((n, *found) for n in partition.numbers if (found := archive.find(n)))
        else:
            first, end = (((1 << 2 * z) - 1) // 3 for z in (self.z, self.z + 1))
            places = (p for p in archive.walk(partition.entries, first, end, partition.after) if self._inside(p[0]))
        for number, data in archive.contents(places):
            if data:
                yield *tile_address(number), data

    def _inside(self, number: int) -> bool:
        _, x, y = tile_address(number)
        return self.x0 <= x <= self.x1 and self.y0 <= y <= self.y1


class FilteringReader(TileReader):
    """A reader that takes filters; Spark allows it only where the session pushes them to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of z, x and y with whole numbers narrow the range; all others are given back."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if isinstance(f, IsNotNull) and name in ("z", "x", "y"):
                continue
            if name not in ("z", "x", "y") or isinstance(value, bool) or not isinstance(value, int):
                yield f
            elif name == "z":
                if isinstance(f, EqualTo | EqualNullSafe):
                    self.nothing |= value != self.z
                else:
                    yield f
            elif isinstance(f, EqualTo | EqualNullSafe):
                self._narrow(name, value, value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self._narrow(name, value + isinstance(f, GreaterThan), None)
            elif isinstance(f, LessThan | LessThanOrEqual):
                self._narrow(name, None, value - isinstance(f, LessThan))
            else:
                yield f

    def _narrow(self, name: str, low: int | None, high: int | None) -> None:
        a, b = getattr(self, f"{name}0"), getattr(self, f"{name}1")
        a, b = a if low is None else max(a, low), b if high is None else min(b, high)
        setattr(self, f"{name}0", a)
        setattr(self, f"{name}1", b)
        self.nothing |= a > b


class TileArchive(DataSource):
    """Tiles of a zoom within a box; tiles that are missing or empty give no row."""

    @classmethod
    def name(cls) -> str:
        return "tile_archive"

    def schema(self) -> str:
        return "z int, x int, y int, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringReader if self.options.get("filters") == "push" else TileReader)(self.options)


def read(spark: SparkSession, path: str, z: int = 14, **options: str) -> DataFrame:
    """(z, x, y, content) of an archive's tiles of one zoom; takes filters where the session pushes them to Python sources."""
    spark.dataSource.register(TileArchive)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    return spark.read.format("tile_archive").options(path=path, z=str(z), **({"filters": "push"} if push else {}), **options).load()
