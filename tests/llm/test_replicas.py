"""Mixing never goes beyond its cap; the audit finds any damage of a replica, and damaged archives give errors as rows."""

from __future__ import annotations

import gzip
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rooftide.llm import mixing, warc


def test_nothing_comes_more_often_than_the_cap(spark: SparkSession) -> None:
    rows = [(k, "a", None if k % 3 else "") for k in range(300)] + [(k, "a", "one two") for k in range(300, 320)] + [(k, "b", "w " * 50) for k in range(320, 340)]
    docs = spark.createDataFrame([(None if k % 5 == 0 else k, s, t) for k, s, t in rows], "doc_id long, source string, text string")
    mixed = mixing.mix(docs, weights=(50.0, 1.0)).collect()
    assert len(mixed) == 340 and max(r.repeats for r in mixed) <= 2
    assert all(r.repeats == 2 for r in mixed if r.source == "a" and r["size"])  # at its cap, as a whole
    assert mixing.repeated(mixing.mix(docs, weights=(50.0, 1.0))).where("source = 'a'").count() == 2 * 320


def test_rows_without_a_key_are_drawn_apart(spark: SparkSession) -> None:
    docs = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    drawn = docs.select(mixing.draw(F.col("doc_id"), 20, F.xxhash64("source", "text")).alias("h"))
    assert drawn.distinct().count() == 300
    taken = mixing.mix(docs, share=0.5).agg(F.sum("repeats")).first()[0]
    assert 140 <= taken <= 160


def test_any_flipped_byte_is_found(spark: SparkSession) -> None:
    pages = spark.createDataFrame([(k, f"http://h{k % 7}/", f"<p>{'text ' * (k % 40)}</p>") for k in range(3000)], "page_id long, url string, html string")
    hit = (F.xxhash64("page_id") % 101) == 5
    cutoff = (F.xxhash64("page_id", F.lit(1)) % 301) == 7
    at = F.pmod(F.xxhash64("page_id", F.lit(2)), F.octet_length("content")).cast("int")
    other = F.concat(F.substring("content", F.lit(1), at), F.lit(b"\xfe"), F.substring("content", at + 2, F.octet_length("content")))
    flip = lambda key, content: F.when(cutoff, F.substring(content, F.lit(1), F.octet_length(content) - 1)).when(hit, other).otherwise(content)
    first = warc.inventory(pages).drop("page_id")
    second = warc.inventory(pages, stored=flip)
    found = warc.audit(first, second.where("page_id % 500 <> 3").drop("page_id"))
    told = {r.page_id: r.verdict for r in found.join(warc.inventory(pages).select("archive", "offset", "page_id"), ["archive", "offset"]).collect()}
    want = {r.page_id: "changed" for r in pages.where(hit | cutoff).select("page_id").collect()} | {k: "missing" for k in range(3, 3000, 500)}
    assert told == want and len(want) > 20


def test_damaged_archives_give_rows(spark: SparkSession, tmp_path: Path) -> None:
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>") for k in range(4)], "page_id long, url string, html string")
    parts = [bytes(r.content) for r in warc.archive(pages).orderBy("page_id").collect()]
    zipped = [gzip.compress(p) for p in parts]
    files = {
        "cut.warc": b"".join(parts)[:-9], "junk.warc": parts[0] + b"junk" + parts[1], "cut.warc.gz": b"".join(zipped)[:-9],
        "bad.warc.gz": zipped[0] + zipped[1][:12] + b"\xff\xff\xff" + zipped[1][15:] + zipped[2], "good.warc": b"".join(parts), "empty.warc": b"", "length.warc": parts[0].replace(b"Content-Length", b"Content-Lost"),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found: dict[str, list] = {name: [] for name in files}
    for r in warc.scan(spark.read.format("binaryFile").load(str(tmp_path))).collect():
        found[r.archive.rpartition("/")[2]].append(r)
    good = {name: sum(r.error is None for r in rows) for name, rows in found.items()}
    errors = {name: [r.offset for r in rows if r.error] for name, rows in found.items()}
    assert good == {"cut.warc": 3, "junk.warc": 1, "cut.warc.gz": 3, "bad.warc.gz": 1, "good.warc": 4, "empty.warc": 0, "length.warc": 0}
    assert errors == {"cut.warc": [sum(map(len, parts[:3]))], "junk.warc": [len(parts[0])], "cut.warc.gz": [sum(map(len, zipped[:3]))], "bad.warc.gz": [len(zipped[0])], "good.warc": [], "empty.warc": [], "length.warc": [0]}
