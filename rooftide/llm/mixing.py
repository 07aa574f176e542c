"""Mixing sources to target weights: capped water-filling with seeded repetitions.

Each source gets a share of the mix by its weight.  A source whose share is
above ``max_epochs`` times its own size is clamped there and the excess goes to
the others by weight, until no share is above its cap.  Sorted by cap per
weight, the clamped sources are a prefix, so one window over the (few) sources
finds the level at which that ends.

A source is then repeated floor(target / size) times as a whole; the fractional
rest takes documents in the order of a seeded hash until its words are used up.
To find where that is, words are summed by source and hash cell, and the cell that
holds the border is divided into cells again; only the one of those that holds
it, a share of 2**-24 of a source, is ordered row by row.

Cases: null text has size 0; sources are ordered by code point, null last, as a
source of its own; a source of size 0 has target 0; ties in the hash are
ordered by key, size and text hash (rows equal in all of these are
interchangeable); rows with a null key are drawn by a hash of source and text;
empty texts are taken where their place is before the border or their source is
taken once as a whole, never more than ``max_epochs`` times; an empty table gives an empty result;
columns with the names of the result are replaced, all others are kept, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

CELL_BITS = 12
#: Sources up to which the table of levels is broadcast (a few dozen bytes each); beyond it a plain join is planned.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int, row: Column) -> Column:
    """60 seeded bits of a key; rows without a key are told apart by a hash of what they hold."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.concat(F.lit("row "), row.cast("string"))))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def levels(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Targets of (source, source_size) rows; weights repeat over the sources in order."""
    every, order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sizes.select("source", "source_size", pick.cast("double").alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"), (F.sum("source_size").over(every) * F.lit(float(share))).alias("words"))
    table = table.withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    table = table.withColumn("level", (F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest)
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)
    table = table.withColumn("level", free["level"])
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 20, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``repeats``, the times a row is taken.

    ``share`` is the size of the mix over the size of all sources.
    """
    own = ("size", "source_size", "target", "repeats")
    kept = [c for c in docs.columns if c.lower() not in own]
    row = F.struct(*kept).alias("row") if kept else F.lit(None).alias("row")
    rows = docs.select(row, F.col(key).alias("key"), F.col(source).alias("source"), draw(F.col(key), seed, F.xxhash64(source, text)).alias("h"), F.crc32(F.col(text)).alias("crc"), word_count(F.col(text)).alias("size"))
    rows = rows.withColumn("cell", F.shiftright("h", 60 - CELL_BITS)).withColumn("fine", F.shiftright("h", 60 - 2 * CELL_BITS).bitwiseAND((1 << CELL_BITS) - 1))
    cells = cut(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")))
    targets = levels(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    start = targets.select("*", F.lit(0).cast("long").alias("before"))
    coarse = cut(border(cells, start, "cell"))
    inside = told(rows, coarse).where(F.col("cell") == F.col("border_cell"))
    fine = inside.groupBy("source", "fine").agg(F.sum("size").alias("words"))
    plan = cut(border(fine, coarse, "fine"))
    placed = told(rows, plan)
    # a source that is at its cap has no rest, so nothing of it comes once more, be it empty
    more = F.col("rest") > 0
    past = (F.col("cell") < F.col("border_cell")) | (F.col("cell") == F.col("border_cell")) & (F.col("fine") < F.col("border_fine"))
    at = (F.col("cell") == F.col("border_cell")) & (F.col("fine") == F.col("border_fine"))
    sure = placed.where(~at).select("row", "size", "source_size", "target", (F.col("whole") + (more & past).cast("int")).alias("repeats"))
    line = Window.partitionBy("source").orderBy("h", "key", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    used = F.col("before") + F.coalesce(F.sum("size").over(line), F.lit(0))
    last = placed.where(at).select("row", "size", "source_size", "target", (F.col("whole") + (more & (used + F.col("size") / 2 <= F.col("rest"))).cast("int")).alias("repeats"))
    mixed = sure.unionByName(last)
    return mixed.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), *own)


def border(cells: DataFrame, plan: DataFrame, name: str) -> DataFrame:
    """``plan`` with ``border_<name>``, the first cell of each source in which the rest is used up (behind the last one if none), and ``before``, the words before it."""
    running = Window.partitionBy("c.source").orderBy(f"c.{name}").rowsBetween(Window.unboundedPreceding, -1)
    joined = cells.alias("c").join(plan.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
    summed = joined.select(F.col("c.source").alias("source"), f"c.{name}", "c.words", "t.rest", (F.col("t.before") + F.coalesce(F.sum("c.words").over(running), F.lit(0))).alias("so_far"))
    found = summed.where(F.col("so_far") + F.col("words") > F.col("rest")).groupBy("source").agg(F.min(F.struct(name, "so_far")).alias("border"))
    others = [c for c in plan.columns if c != "before"]
    both = plan.alias("t").join(found.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left")
    return both.select(*(F.col(f"t.{c}").alias(c) for c in others), F.coalesce(F.col(f"b.border.{name}"), F.lit(1 << CELL_BITS)).alias(f"border_{name}"), F.coalesce(F.col("b.border.so_far"), F.col("t.before")).alias("before"))


def told(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with what the plan says of their source."""
    plan = plan.withColumnRenamed("source", "of")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``repeats`` says."""
    return mixed.where(F.col("repeats") > 0).withColumn("repeats", F.explode(F.sequence(F.lit(1), F.col("repeats"))))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS words FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (
  SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv
  FROM r),
f AS (SELECT first(lv ORDER BY ratio) AS lv FROM l WHERE lv <= ratio),
t AS (
  SELECT source, source_size, CASE WHEN f.lv IS NULL OR ratio <= f.lv THEN cap ELSE f.lv * weight END AS target
  FROM l LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
o AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
x AS (SELECT * FROM o)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN used + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
