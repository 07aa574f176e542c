"""WARC records and a Merkle fixity audit of replicas.

A replica is a table of records: archive, offset and bytes.  Each record is
hashed; the hashes of one offset range of an archive, in order, make the range's
hash; ranges of 16 times the size are hashed from those below, up to the
archive's root.  The audit compares roots and goes down only where they differ,
level by level, until it holds the records of the ranges that differ.

Records are measured and hashed where they are read: what is shuffled is their
archive, offset, length and digest, never their content.  Hashes are grouped by
archive and offset range; records have at least their header's bytes, which
bounds the records of a range.

Cases: null text or url is an empty one; rows without a key are dealt to
archives of their own (-1 and below) by their digest; archives that one replica
lacks are damage in all their records; records that stand at one offset more
than once are hashed in the order of their hashes; empty replicas give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Bits of an offset below the lowest range, and more bits for each level above it; the root is above the last level.
RANGE_BITS, LEVEL_BITS, LEVELS = 16, 4, 3
CRLF, GZIP = "\r\n", b"\x1f\x8b"


def record(page: Column, url: Column, body: Column, when: str = "2024-01-01T00:00:00Z") -> Column:
    """A WARC/1.0 resource record as binary."""
    text = F.coalesce(body, F.lit(""))
    head = ["WARC/1.0", "WARC-Type: resource"]
    lines = [F.lit(CRLF.join(head) + CRLF), F.lit("WARC-Record-ID: <urn:page:"), page.cast("string"), F.lit(f">{CRLF}WARC-Date: {when}{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(text).cast("string"), F.lit(CRLF * 2), text, F.lit(CRLF * 2)]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in lines]).cast("binary")


def _number(key: Column, digest: Column, per_archive: int) -> Column:
    lost = -1 - F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")
    return F.coalesce(F.floor(key / per_archive).cast("long"), lost)


def inventory(pages: DataFrame, per_archive: int = 1024, key: str = "page_id", url: str = "url", html: str = "html", stored: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(archive, offset, key, length, digest) of pages as the records of archives of ``per_archive`` ids, in the order of ids.

    ``stored`` tells, from the key and a record's bytes, the bytes that a replica holds in its place; offsets are those of
    the records as written, lengths and digests those of the bytes as held.
    """
    written = record(F.col(key), F.col(url), F.col(html))
    read = pages.select(F.col(key).alias(key), written.alias("content"), (written if stored is None else stored(F.col(key), written)).alias("held"))
    size = lambda c: F.octet_length(c).cast("long")
    narrow = read.select(key, size("content").alias("room"), F.sha2("content", 256).alias("order"), size("held").alias("length"), F.sha2("held", 256).alias("digest"))
    rows = narrow.withColumn("archive", _number(F.col(key), F.col("order"), per_archive))
    before = Window.partitionBy("archive").orderBy(key, "order").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("room").over(before), F.lit(0)).cast("long")).select("archive", "offset", key, "length", "digest")


def archive(pages: DataFrame, per_archive: int = 1024, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive, offset, key, content): the records of :func:`inventory` with their content, for writing archives."""
    rows = pages.select(F.col(key).alias(key), record(F.col(key), F.col(url), F.col(html)).alias("content"))
    digest = F.sha2("content", 256)
    before = Window.partitionBy("archive").orderBy(key, digest).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(_number(F.col(key), digest, per_archive).alias("archive"), key, "content")
    return placed.withColumn("offset", F.coalesce(F.sum(F.octet_length("content")).over(before), F.lit(0)).cast("long"))


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive, or of the whole where it isn't compressed."""
    if data[:2] != GZIP:
        yield 0, len(data), data
        return
    at = 0
    while at < len(data):
        unpack = zlib.decompressobj(31)
        content = unpack.decompress(data[at:])
        if not unpack.eof:
            raise ValueError(f"the gzip member at offset {at} is cut off")
        size = len(data) - at - len(unpack.unused_data)
        yield at, size, content
        at += size


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in lower case, block) of the records of an uncompressed archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at offset {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        stop = end + 4 + size + 4
        if stop > len(data):
            raise ValueError(f"the record at offset {at} is cut off")
        yield at, stop - at, headers, data[end + 4 : end + 4 + size]
        at = stop


def scan(files: DataFrame) -> DataFrame:
    """(archive, offset, length, url, time, content, error): the records of files read as ``binaryFile``; archive is the path.

    Offset and length are those in the file: of the gzip member, where each record is one.  A file is a row, as that
    source reads it (2 GB at most); its records come out in batches of some megabytes.  Where a file is damaged its last
    row has no content but an ``error``, at the offset from which nothing more could be read.
    """
    types = {"archive": pa.string(), "offset": pa.int64(), "length": pa.int64(), "url": pa.string(), "time": pa.timestamp("us", "UTC"), "content": pa.binary(), "error": pa.string()}

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

    def records(path: str, file: bytes) -> Iterator[tuple]:
        reached = 0
        try:
            for start, size, data in members(file):
                for at, n, h, _ in parse(data):
                    when = datetime.fromisoformat(h["warc-date"]).astimezone(UTC) if "warc-date" in h else None
                    whole = n == len(data)
                    yield path, start + (0 if whole else at), size if whole else n, h.get("warc-target-uri"), when, data[at : at + n], None
                    reached = start + (0 if file[:2] == GZIP else at + n)
                reached = start + size
        except (ValueError, KeyError, zlib.error) as e:
            yield path, reached, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            rows, held = [], 0
            for row in records(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""):
                rows.append(row)
                held += len(row[5] or b"")
                if held > 8 << 20:
                    yield packed(rows)
                    rows, held = [], 0
            yield packed(rows)

    return map_arrow(files.select("path", "content"), run, "archive string, offset bigint, length bigint, url string, time timestamp, content binary, error string")


def leaves(replica: DataFrame, *also: str) -> DataFrame:
    """(archive, offset, length, digest) of every record, and any columns asked for."""
    return replica.select(*also, "archive", "offset", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("digest"))


def nodes(records: DataFrame) -> list[DataFrame]:
    """(archive, at, digest) of each level, the roots first; ``at`` is the number of the offset range."""
    entry = F.struct("at", "digest")

    def joined(rows: DataFrame, at: Column) -> DataFrame:
        hashes = F.transform(F.sort_array(F.collect_list("entry")), lambda x: x["digest"])
        return rows.select("archive", at.alias("to"), entry.alias("entry")).groupBy("archive", "to").agg(F.sha2(F.concat_ws("", hashes), 256).alias("digest")).withColumnRenamed("to", "at")

    found = [cut(joined(records.withColumnRenamed("offset", "at"), F.shiftright("at", RANGE_BITS)))]
    for _ in range(LEVELS - 1):
        found.append(joined(found[-1], F.shiftright("at", LEVEL_BITS)))
    found.append(joined(found[-1], F.lit(0).cast("long")))
    return found[::-1]


def audit(one: DataFrame, two: DataFrame, tree: list[DataFrame] | None = None) -> DataFrame:
    """(archive, offset, length, verdict) of the records of two :func:`leaves` tables that differ.

    ``verdict`` is ``changed``, ``missing`` (the second replica lacks it) or ``extra``; ``tree`` is what :func:`nodes`
    gave for the first one, if it is at hand.  Each level's differences are written before the next one is compared.
    """
    differ = None
    for level, (a, b) in enumerate(zip(tree or nodes(one), nodes(two), strict=True)):
        if differ is not None:
            a, b = (_inside(x, differ, F.shiftright("at", LEVEL_BITS if level > 1 else 63)) for x in (a, b))
        both = a.withColumnRenamed("digest", "one").join(b.withColumnRenamed("digest", "two"), ["archive", "at"], "full")
        differ = cut(both.where(~F.col("one").eqNullSafe(F.col("two"))).select("archive", "at"))
    a, b = (_inside(x, differ, F.shiftright("offset", RANGE_BITS)) for x in (one, two))
    a = a.select("archive", "offset", "length", F.col("digest").alias("one"))
    b = b.select("archive", "offset", F.col("length").alias("length_two"), F.col("digest").alias("two"))
    both = a.join(b, ["archive", "offset"], "full").where(~F.col("one").eqNullSafe(F.col("two")))
    verdict = F.when(F.col("two").isNull(), "missing").when(F.col("one").isNull(), "extra").otherwise("changed")
    return both.select("archive", "offset", F.coalesce("length", "length_two").alias("length"), verdict.alias("verdict"))


def _inside(rows: DataFrame, ranges: DataFrame, up: Column) -> DataFrame:
    """The rows that lie in one of the ranges (archive, at)."""
    return rows.withColumn("up", up).join(ranges.select("archive", F.col("at").alias("up")), ["archive", "up"], "left_semi").drop("up")


def roots(tree: list[DataFrame]) -> DataFrame:
    """(archive, root) of what :func:`nodes` gave."""
    return tree[0].select("archive", F.col("digest").alias("root"))


def _sql() -> str:
    crlf = "chr(13) || chr(10)"
    levels, last = [], "l0"
    for k in range(1, LEVELS):
        levels.append(f"l{k} AS (SELECT archive, pos >> {LEVEL_BITS} AS pos, sha256(string_agg(digest, '' ORDER BY pos, digest)) AS digest FROM l{k - 1} GROUP BY archive, pos >> {LEVEL_BITS})")
        last = f"l{k}"
    return f"""
WITH b AS (
  SELECT page_id, CAST(floor(page_id / 1024) AS BIGINT) AS archive,
         'WARC/1.0' || {crlf} || 'WARC-Type: resource' || {crlf} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {crlf}
         || 'WARC-Date: 2024-01-01T00:00:00Z' || {crlf} || 'WARC-Target-URI: ' || coalesce(url, '') || {crlf}
         || 'Content-Type: text/html' || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) || {crlf} || {crlf}
         || coalesce(html, '') || {crlf} || {crlf} AS content
  FROM pages),
r AS (
  SELECT page_id, archive, strlen(content)::BIGINT AS length, sha256(content) AS digest,
         coalesce(sum(strlen(content)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM b),
l0 AS (SELECT archive, pos >> {RANGE_BITS} AS pos, sha256(string_agg(digest, '' ORDER BY pos, digest)) AS digest FROM r GROUP BY archive, pos >> {RANGE_BITS}),
{", ".join(levels)},
t AS (SELECT archive, sha256(string_agg(digest, '' ORDER BY pos, digest)) AS root FROM {last} GROUP BY archive),
o AS (SELECT page_id, sha256(CASE WHEN page_id % 97 = 13 THEN left(content, length(content) - 1) || '?' ELSE content END) AS other FROM b WHERE page_id % 89 <> 7)
SELECT r.page_id, r.archive, r.pos AS record_offset, r.length AS record_length, r.digest AS record_sha256, t.root AS root_sha256,
       CASE WHEN other IS NULL THEN 'missing' WHEN other <> digest THEN 'changed' ELSE 'ok' END AS verdict
FROM r JOIN t USING (archive) LEFT JOIN o ON r.page_id = o.page_id
"""


ORACLE = _sql()
