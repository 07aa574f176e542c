"""Exact top-k search by pivot-table elimination.

Vectors are compared by integer inner product.  With a and b the squared norms
and d the distance of two vectors, their product is (a + b - d * d) / 2, so a
lower bound of the distance is an upper bound of the product.  Distances from
every vector to many pivots are tabled once, as a column; the largest difference
to the query's own distances is that lower bound.  Candidates are evaluated in
the order of their bounds until the next bound is below the k-th score found.

Queries and candidates meet block by block, so neither side is broadcast and no
task holds more than one block of each.  Blocks hold vectors of one
neighbourhood (near the same pivot, at like distances).  Each query meets the
block of its own neighbourhood first; its k-th score there is where its search
in all other blocks begins, and the k best of all blocks are merged.  Of every
block the least and greatest distance to each pivot and the greatest norm are
kept: they bound all products with it, and a query is sent only to blocks whose
bound reaches its k-th score, a candidate only to blocks of queries that need it.

Cases: vectors that are null, empty, or hold null or non-finite components take
no part; shorter vectors count as padded with zeros; components may be of any
size, and products are exact: in integers of any length where 53 bits don't
hold them (a score that no long holds raises OverflowError); rows without an id
take no part; rows that share an id are one (the smallest vector); equal scores
go to the smaller id; with fewer than k candidates there are fewer rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, cut, map_arrow

PIVOTS, PIVOT_SAMPLE = 32, 512
#: Rows of a block of queries and of candidates, for vectors of up to 64 components; wider ones make smaller blocks.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: Queries, and boxes of blocks, that are bounded against each other at once.
BOUND_QUERIES, BOUND_BOXES = 8192, 2048
#: Bound on the rounding of a tabled distance, as a share of the greatest one to that pivot.
ROUNDING = 1e-6
#: Candidates that are evaluated at once at first; each further wave is three times as large.
WAVE = 256


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): usable vectors as arrays of floor(scale * component), one row per id."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    usable = F.col(key).isNotNull() & (F.size(vector) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return vectors.where(usable).select(F.col(key).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Farthest-first choice from a sample, distinct vectors only."""
    if not len(sample):
        return sample
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of a vector with rows of whole numbers."""
    if q.dtype == object:
        return np.array([sum(int(x) * int(y) for x, y in zip(q, row, strict=True)) for row in c], object)
    return c @ q


def search(query_ids: np.ndarray, queries: np.ndarray, to_q: np.ndarray, ids: np.ndarray, candidates: np.ndarray, to_c: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[list, list, list, int]:
    """The k best candidates of each query whose scores reach ``least``, by pivot distances ``to_q`` and ``to_c``; also how many products were evaluated."""
    most = float(max(np.abs(queries).max(initial=0), np.abs(candidates).max(initial=0))) ** 2 * queries.shape[1]
    exact = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    c, q = candidates.astype(exact), queries.astype(exact)
    # One row per pivot, in single precision; the slack covers its rounding many times over.
    narrow = most < 2.0**100
    to_c, to_q = np.ascontiguousarray(to_c.T, np.float32 if narrow else np.float64), to_q.astype(np.float32 if narrow else np.float64)
    norm_c, norm_q = (candidates * candidates).sum(1), (queries * queries).sum(1)
    slack = 1e-5 * (norm_c.max(initial=0) + norm_q.max(initial=0)) + 0.5
    half = norm_c / 2
    # a pivot much farther away than the vectors are long is rounded by more than the slack holds
    top = np.maximum(to_c.max(1, initial=0)[:, None], to_q.T.max(1, initial=0)[:, None]).ravel() if len(q) else np.zeros(len(to_c))
    rounding = np.where(ROUNDING * np.square(top, dtype=np.float64) > slack, ROUNDING * top, 0).astype(to_c.dtype)
    apart, gap = np.empty(len(c), to_c.dtype), np.empty(len(c), to_c.dtype)
    out_q, out_c, out_s, evaluated = [], [], [], 0
    for i in range(len(q)):
        apart.fill(0)
        for row, own, off in zip(to_c, to_q[i], rounding, strict=True):
            np.abs(np.subtract(row, own, out=gap), out=gap)
            if off:
                np.subtract(gap, off, out=gap)
            np.maximum(apart, gap, out=apart)
        bound = half - np.square(apart, dtype=np.float64) / 2 + (norm_q[i] / 2 + slack) if most < 1e300 else np.full(len(c), np.inf)
        bound[ids == query_ids[i]] = -np.inf
        lowest = -np.inf if least is None else least[i]
        first = np.argpartition(-bound, WAVE)[:WAVE] if len(bound) > WAVE else np.arange(len(bound))
        first = first[(bound[first] > -np.inf) & (bound[first] >= lowest)]
        found, score = first, products(q[i], c[first])
        kth = lambda score, lowest=lowest: max(lowest, np.partition(score, -k)[-k] if len(score) >= k else -np.inf)
        reach = kth(score)
        rest = bound >= reach
        rest[first] = False
        rest = np.flatnonzero(rest & (bound > -np.inf))
        rest = rest[np.argsort(-bound[rest])]
        at, size = 0, WAVE
        while at < len(rest) and bound[rest[at]] >= reach:
            wave = rest[at : at + size]
            product = products(q[i], c)[wave] if 4 * len(wave) > len(c) else products(q[i], c[wave])
            found, score, at, size = np.append(found, wave), np.append(score, product), at + len(wave), 3 * size
            reach = kth(score)
            near = score >= reach
            found, score = found[near], score[near]
        evaluated += len(first) + at
        near = score >= lowest
        found, score = found[near], score[near]
        best = np.lexsort((ids[found], -score))[:k]
        out_q.append(np.full(len(best), query_ids[i]))
        out_c.append(ids[found[best]])
        out_s.append(np.array([int(x) for x in score[best]], np.int64))
    return out_q, out_c, out_s, evaluated


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def tabled(rows: DataFrame, width: int, pivots: np.ndarray) -> DataFrame:
    """Rows (id, v) with ``far``, their distances to the pivots, and ``near``, the number of the nearest one."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(matrix(batch.column(1), width), shared.value)
            if not far.shape[1]:
                far = np.zeros((len(far), 1))
            lists = pa.ListArray.from_arrays(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))], ["id", "v", "far", "near", "apart"])

    return rows.select("id", "v").mapInArrow(arrow(run), "id bigint, v array<double>, far array<double>, near int, apart double")


def ranged(rows: DataFrame, n: int, name: str) -> DataFrame:
    """Rows written with the number (below ``n``) of their range of neighbourhoods; a session may make more partitions than ``n``, which are joined."""
    written = cut(rows.repartitionByRange(n, "near", "apart", "id").withColumn(name, F.spark_partition_id()))
    ranges = written.agg(F.coalesce(F.max(name), F.lit(0))).first()[0] + 1
    return written.withColumn(name, F.floor(F.col(name) * n / max(ranges, n)).cast("int"))


def boxes(table: DataFrame, width: int) -> DataFrame:
    """(home, lo, hi, norm): the least and greatest distances to each pivot and the greatest squared norm of the rows (home, v, far) of each block.

    A block that lies in several partitions gets a box in each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            home = batch.column(0).to_numpy()
            v = matrix(batch.column(1), width)
            far = matrix(batch.column(2), len(batch.column(2)[0]))
            with np.errstate(over="ignore", invalid="ignore"):
                norm = (v * v).sum(1)
            norm[~np.isfinite(far).all(1)] = np.inf
            for b in np.unique(home):
                of = home == b
                lo, hi, most = far[of].min(0), far[of].max(0), norm[of].max()
                old = found.get(int(b))
                found[int(b)] = [lo, hi, most] if old is None else [np.minimum(old[0], lo), np.maximum(old[1], hi), np.maximum(old[2], most)]
        if found:
            lists = lambda k: pa.array([x[k].tolist() for x in found.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), lists(0), lists(1), pa.array([float(x[2]) for x in found.values()])], ["home", "lo", "hi", "norm"])

    return table.select("home", "v", "far").mapInArrow(arrow(run), "home int, lo array<double>, hi array<double>, norm double")


def box_bounds(to_q: np.ndarray, norm_q: float, lo: np.ndarray, hi: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bounds of the products of a query with all that lies in boxes; not a number where sizes overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = np.maximum(lo - to_q, to_q - hi) - ROUNDING * np.maximum(hi, to_q)
        apart = np.maximum(gap.max(1), 0)
        return (norm + norm_q - apart * apart) / 2 + 1e-5 * (norm + norm_q) + 0.5


def reached(asked: DataFrame, box: DataFrame, width: int, n_queries: int, blocks: int) -> DataFrame:
    """(id, b): the blocks other than its own whose bound reaches ``least`` of each query (id, home, v, far, least); all blocks where it is null."""
    groups, parts = -(-blocks // BOUND_BOXES), -(-max(n_queries, 1) // BOUND_QUERIES)
    dealt = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    none = F.lit(None)
    queries = asked.select(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(parts)).cast("int").alias("part"), dealt(groups).alias("group"), F.col("id"), "home", F.col("far").alias("lo"), none.cast("array<double>").alias("hi"), norm.alias("norm"), "least")
    offered = box.select(dealt(parts).alias("part"), F.pmod("home", F.lit(groups)).cast("int").alias("group"), none.cast("bigint").alias("id"), "home", "lo", "hi", "norm", none.cast("double").alias("least"))
    met = queries.unionByName(offered).groupBy("part", "group").agg(F.collect_list(F.struct("id", "home", "lo", "hi", "norm", "least")).alias("m"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(batch.num_rows):
            m = batch.column(0)[at].values
            query = np.asarray(m.field("id").is_valid())
            if query.all() or not query.any():
                continue
            own, other = m.filter(pa.array(query)), m.filter(pa.array(~query))
            lo, hi = (matrix(other.field(c), len(other.field("lo")[0])) for c in ("lo", "hi"))
            b, most = other.field("home").to_numpy(), other.field("norm").to_numpy()
            far, norms = matrix(own.field("lo"), lo.shape[1]), own.field("norm").to_numpy()
            ids, home = own.field("id").to_numpy(), own.field("home").to_numpy()
            least = own.field("least").to_numpy(zero_copy_only=False).astype(np.float64)
            found = []
            for i in range(len(ids)):
                ruled_out = box_bounds(far[i], norms[i], lo, hi, most) < least[i]  # false for what is not a number
                found.append(np.unique(b[~ruled_out & (b != home[i])]))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in found])), pa.array(np.concatenate(found).astype(np.int32))], ["id", "b"])

    return map_arrow(met.select("m"), run, "id bigint, b int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best of all other rows for each row where ``is_query`` (of the column ``id``) holds."""
    rows = cut(quantised(vectors, key, vector, scale))
    n, width, n_queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1)), F.count(F.when(is_query, 1))).first()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()
    padded = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        padded[i, : len(r["v"])] = r["v"]
    pivots = choose_pivots(padded)
    wide = max(96, width + PIVOTS)
    query_block, candidate_block = max(QUERY_BLOCK * 96 // wide, 1), max(CANDIDATE_BLOCK * 96 // wide, 1)
    query_blocks, blocks = -(-max(n_queries, 1) // query_block), -(-max(n, 1) // candidate_block)
    # neighbourhoods: ranges of (nearest pivot, distance to it); the blocks are fixed by what is written
    table = ranged(tabled(rows, width, pivots), blocks, "home")
    asked = table.where(is_query)
    none = F.lit(None).cast("double").alias("least")
    column = ("id", "v", "far")

    def meet(asked: DataFrame, offered: DataFrame) -> DataFrame:
        """The best candidates in each block (a, b) of queries and candidates."""
        both = asked.select(F.lit(True).alias("q"), "a", "b", *column, "least").unionByName(offered.select(F.lit(False).alias("q"), "a", "b", *column, none))
        met = both.groupBy("a", "b").agg(F.collect_list(F.struct("q", *column, "least")).alias("m"))

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(batch.num_rows):
                m = batch.column(0)[at].values
                ids, query = m.field("id").to_numpy(), m.field("q").to_numpy(zero_copy_only=False)
                v, far = matrix(m.field("v"), width), matrix(m.field("far"), max(len(pivots), 1))
                least = m.field("least").to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                mine, others = order[query[order]], order[~query[order]]
                lowest = np.where(np.isnan(least[mine]), -np.inf, least[mine])
                q, c, s, _ = search(ids[mine], v[mine], far[mine], ids[others], v[others], far[others], k, lowest)
                if q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, c, s)], ["query_id", "id", "score"])

        return map_arrow(met.select("m"), run, "query_id bigint, id bigint, score bigint")

    # the home block first; its queries are dealt into blocks of their own
    home = asked.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("parts"))
    at_home = asked.join(home, "home").select(F.pmod(F.xxhash64(F.lit(1), "id"), F.col("parts")).cast("int").alias("a"), F.col("home").alias("b"), *column, none)
    offered = table.join(home, "home").select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("a"), F.col("home").alias("b"), *column)
    first = cut(meet(at_home, offered))
    others = first.limit(0)
    if blocks > 1:
        reach = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        known = asked.join(reach.select(F.col("query_id").alias("id"), F.col("least").cast("double")), "id", "left")
        # blocks of queries are ranges of neighbourhoods too, so that queries of a block need the same candidates
        known = ranged(known.select("home", *column, "near", "apart", "least"), query_blocks, "a")
        sent = cut(reached(known, boxes(table, width), width, n_queries, blocks).join(known.select("id", "a"), "id"))
        abroad = sent.join(known.select(*column, "least"), "id").select("a", "b", *column, "least")
        offered = table.join(sent.select("a", F.col("b").alias("home")).distinct(), "home").select("a", F.col("home").alias("b"), *column)
        others = meet(abroad, offered)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = first.unionByName(others)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
