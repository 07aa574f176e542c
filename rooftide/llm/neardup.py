"""Near-duplicate groups by SetSketch registers.

A document is its set of distinct word shingles, as 64-bit hashes.  Documents
with equal sets are one class.  Each class gets ``REGISTERS`` registers, each a
minimum of the set's hashes on an exponential scale of base ``BASE``, cut off
to 16 bits; registers of a union are the larger of the two, and two sets agree
in a register about as often as their similarity.

Bands of registers bring classes together in buckets.  Buckets with the same
members are one list.  In a list, the joint likelihood of the registers' order
and the known set sizes gives an estimate for each pair; members without a
likely partner leave.  What is left meets with full sets, and links are
confirmed there exactly.  Lists that share members make a cluster: one that a
task can hold is met as a whole, so that each set moves once.  In larger ones
each class meets its largest list first, and then the other lists that still
join two groups.  No step makes all pairs of a group: what meets only hands on
links that join two of its groups, found by a count of shared shingles with one
member of each.

A list of more members or bytes than a task should hold is dealt into blocks,
each with the list's first member.  What a block doesn't join to that member
then meets the other blocks.  Lists of more than ``BLOCK`` members skip the
estimate.

The number of registers in a band follows from the threshold: a pair at it
shares no band with a probability of 3e-9 at most.  Its estimate is
``deviations`` standard deviations too low with one of 1e-9 (at 6); with None
every member of a bucket is confirmed exactly.

Cases: null and empty texts, and texts of white space, have the empty set: they
link with nothing, and are their own component; with fewer words than a
shingle has, the whole sequence is the one shingle; rows that share a key may
have different texts, each of which is linked by itself; rows with a null key
are never linked and their component is null; texts of any length are taken
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, WORD, arrow, cut, map_arrow, slices, whole_groups

REGISTERS, BASE = 256, 1.02
#: Members of a list, and bytes of full sets, that a task takes at once (a larger set comes with the list's first one).
BLOCK, BLOCK_BYTES = 4096, 24 << 20
#: Bits of the filter that says which full sets may be needed, and sets up to which it is used; beyond, a join says it.
FILTER_BITS, FILTER_SETS = 25, 4_000_000
CACHE_WORDS, LONG = 100_000, 256
#: Bytes of text that are worked on at once; rows of a sorted table.
SLICE, ROWS = 1 << 20, 8192
#: Members of a list up to which its pairs are looked at together with those of other lists.
SMALL = 24
FOLD = bytes(LOWER_ASCII.get(i, i) for i in range(256))
_RANDOM = np.random.default_rng(7)
LOW, HIGH = (_RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1) for _ in range(2))
FACTORS = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of texts; hashes of words are kept between texts."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles."""
        words = (text or "").encode().translate(FOLD).split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        fresh = [w for w in set(words) if w not in known]
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in fresh)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if any(len(w) > LONG for w in fresh):
            known.clear()
        n = min(self.words, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = mixed(out + h[k : k + len(out)] * FACTORS[k])
        return np.unique(out + np.uint64(n))


def registers(shingles: np.ndarray) -> np.ndarray:
    """Exponentially spaced, truncated minima of a set."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(shingles), 512):
        np.minimum(least, (low[a : a + 512, None] * LOW + high[a : a + 512, None] * HIGH).min(0), out=least)
    rate = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(rate) / math.log(BASE)), 0, 65535).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of similarity j, given how many registers of the first set are larger, smaller and equal, and the set sizes; concave in j."""
    u, v = n / (n + m), m / (n + m)
    chance = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1)
    p, q = chance(u - v * j), chance(v - u * j)
    return more * np.log(p) + less * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-12, 1))


def estimate(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most likely similarity, in hundredths of the greatest that the sizes allow."""
    grid = np.linspace(0, 1, 101)[:, None] * (np.minimum(n, m) / np.maximum(n, m))
    return np.take_along_axis(grid, log_likelihood(grid, more, less, equal, n, m).argmax(0)[None], 0)[0]


def at_least(least: float, regs: np.ndarray, others: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs have a most likely similarity of at least ``least``: the likelihood still rises there."""
    equal = (others == regs).sum(1)
    may = np.minimum(n, m) >= least * np.maximum(n, m)
    more = (others < regs).sum(1)
    found = (more, REGISTERS - more - equal, equal, n.astype(float), m.astype(float))
    return may & (log_likelihood(np.float64(least), *found) >= log_likelihood(np.float64(least - 1e-3), *found))


def likely(regs: np.ndarray, sizes: np.ndarray, bounds: list[tuple[int, int]], least: float) -> np.ndarray:
    """Which rows have a partner in their group that may be similar enough."""
    keep, end, large = np.zeros(len(regs), bool), np.arange(len(regs)), []
    for a, b in bounds:
        if b - a > SMALL:
            large.append((a, b))
        else:
            end[a:b] = b
    for step in range(1, SMALL):  # all pairs of small groups
        i = np.flatnonzero(np.arange(len(regs)) + step < end)
        i = i[~(keep[i] & keep[i + step])]
        if len(i):
            found = i[at_least(least, regs[i], regs[i + step], sizes[i], sizes[i + step])]
            keep[found] = keep[found + step] = True
    for a, b in large:
        for i in range(a, b - 1):
            later = np.arange(i + 1, b)
            later = later[~keep[later]] if keep[i] else later
            if len(later):
                found = later[at_least(least, regs[i], regs[later], np.full(len(later), sizes[i]), sizes[later])]
                keep[found] = True
                keep[i] |= len(found) > 0
    return keep


def rows_per_band(threshold: float) -> int:
    """Registers of a band: the most with which a pair at the threshold misses all bands with a probability of 3e-9 at most."""
    fit = [r for r in range(1, 17) if (1 - threshold**r) ** (REGISTERS // r) <= 3e-9]
    if not fit:
        raise ValueError(f"{REGISTERS} registers can't find pairs as dissimilar as {threshold}")
    return max(fit)


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join all members which the links of these sets connect."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, popular = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    weight = np.bincount(popular)
    group, out = np.arange(n), []
    flag = np.zeros(len(flat), bool)

    def row(i: int) -> None:
        own = popular[starts[i] : starts[i] + sizes[i]]
        flag[own] = True
        both = np.add.reduceat(flag[popular], starts, dtype=np.int64)
        flag[own] = False
        linked = 100 * both >= percent * (sizes + sizes[i] - both)
        for g in np.unique(group[linked & (group != group[i])]).tolist():
            out.append((i, int(np.flatnonzero(linked & (group == g))[0])))
        group[np.isin(group, group[linked])] = group[i]

    row(int(np.argmax(np.add.reduceat(weight[popular], starts) / sizes)))  # the member with the most common shingles
    order = np.argsort(-np.bincount(group, minlength=n)[group], kind="stable")
    largest = group[order[0]]
    for i in order.tolist():  # with rows for all members of all but one group, every pair between groups is looked at
        if group[i] != largest and not (group == group[i]).all():
            row(i)
            if group[order[0]] != largest:
                largest = group[order[0]]
    return out


def sketch(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(doc, text_hash, n_shingles, class, regs) of every row; class is a 128-bit hash of the set, null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                sets = [shingler(t) for t in part.column(1).to_pylist()]
                kinds = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                regs: dict[bytes, bytes] = {}
                for k, s in zip(kinds, sets, strict=True):
                    if k is not None and k not in regs:
                        regs[k] = registers(s).tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(map(len, sets), pa.int64()), pa.array(kinds, pa.binary()), pa.array([regs.get(k) for k in kinds], pa.binary())], ["doc", "text_hash", "n_shingles", "class", "regs"])

    read = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return read.mapInArrow(arrow(run), f"doc {docs.schema[key].dataType.simpleString()}, text_hash bigint, n_shingles bigint, class binary, regs binary")


def band_rows(classes: DataFrame, per_band: int) -> DataFrame:
    """(band, rep): one row for each class and band, the band with its registers as one 64-bit key."""
    bands = REGISTERS // per_band

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(a, 2000) for a in range(0, batch.num_rows, 2000)):
            regs = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS)[:, : bands * per_band]
            keys = (np.arange(1, bands + 1, dtype=np.uint64) * FACTORS[15])[None, :].repeat(len(regs), 0)
            for k in range(per_band):
                keys = mixed(keys + regs[:, k::per_band].astype(np.uint64) * FACTORS[k])
            reps = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(reps)], ["band", "rep"])

    return map_arrow(classes.select("rep", "regs"), run, "band bigint, rep bigint")


def lists(bands: DataFrame) -> DataFrame:
    """(list, rep, n): the members of all buckets with two or more, those with the same members once."""
    dealt = bands.repartition("band")
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "rep"))
    many = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("one"), F.max("rep").alias("two"), mark(1).alias("x"), mark(2).alias("y")).where("n > 1")
    once = many.groupBy("n", "one", "two", "x", "y").agg(F.min("band").alias("list"))
    pairs = once.where("n = 2").select("list", F.explode(F.array("one", "two")).alias("rep"), "n")
    others = dealt.withColumnRenamed("band", "list").join(once.where("n > 2").select("list", "n"), "list").select("list", "rep", "n")
    return pairs.unionByName(others)


def by_group(t: pa.Table) -> list[tuple[int, int]]:
    """The bounds of a sorted table's groups."""
    keys = t.column("group").to_numpy()
    starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1) if len(keys) else np.empty(0, int)
    ends = np.append(starts[1:], len(keys)).astype(int)
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a group side by side."""
    return rows.repartition("group").sortWithinPartitions("group")


def likely_members(members: DataFrame, classes: DataFrame, threshold: float, deviations: float | None) -> DataFrame:
    """The (list, rep, n) rows whose member has a likely partner in the list."""
    if deviations is None:
        return members
    least = threshold - deviations * math.sqrt(threshold * (1 - threshold) / REGISTERS)
    full = members.where(F.col("n") <= BLOCK).join(classes.select("rep", "n_shingles", "regs"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "group", ROWS):
            regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
            keep = likely(regs, t.column("n_shingles").to_numpy(), by_group(t), least)
            yield from t.filter(pa.array(keep)).select(["group", "rep", "n"]).rename_columns(["list", "rep", "n"]).combine_chunks().to_batches()

    found = dealt(full.select(F.col("list").alias("group"), "rep", "n", "n_shingles", "regs")).mapInArrow(arrow(run), "list bigint, rep bigint, n bigint")
    return found.unionByName(members.where(F.col("n") > BLOCK))


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(rep, shingles) of the classes (rep, doc, class) that are wanted, from one of their documents."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    bit = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS)).cast("int").alias("bit")
    bits = None
    if wanted.count() <= FILTER_SETS:  # at most that many numbers reach the driver, and 2**FILTER_BITS bits each task
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[wanted.select(bit).distinct().toArrow().column(0).to_numpy()] = True
        bits = spark.sparkContext.broadcast(np.packbits(bits))
        read = read.select("doc", "text", bit)
    else:
        read = read.join(wanted.select("doc").distinct(), "doc", "left_semi").select("doc", "text", F.lit(0).alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            if bits is not None:
                at = batch.column(2).to_numpy()
                batch = batch.take(pa.array(np.flatnonzero(bits.value[at >> 3] >> (7 - (at & 7)) & 1)))
            for part in slices(batch, 1, SLICE) if batch.num_rows else ():
                sets = [shingler(t) for t in part.column(1).to_pylist()]
                kinds = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kinds, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "class", "shingles"])

    found = read.mapInArrow(arrow(run), f"doc {kind}, class binary, shingles binary")
    # a key that repeats with one text gives its set more than once: equal rows, side by side after the join
    return found.join(wanted, ["doc", "class"]).groupBy("doc", "class").agg(F.any_value("rep").alias("rep"), F.any_value("shingles").alias("shingles")).select("rep", "shingles")


def confirmed(members: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str, whole: bool = False) -> DataFrame:
    """(a, b): exact links that join what is connected within each list of (list, rep).

    With ``whole``, lists are known to fit into a task, and each member that links join to others has one link, to the
    smallest of them (itself included).
    """
    wanted = cut(members.select("rep").distinct().join(classes.select("rep", "doc", "class", "n_shingles"), "rep"))
    sets = full_sets(docs, wanted.select("rep", "doc", "class"), words, key, text)
    if not whole:
        sets = cut(sets)

    def meet(met: DataFrame) -> DataFrame:
        """(a, b) links of (list, rep, first, blocks) in groups; a null b marks a member that isn't joined to the first one of a list in blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in whole_groups(batches, "group", ROWS):
                reps, lead, many, of = (t.column(c).to_numpy() for c in ("rep", "first", "blocks", "list"))
                held = t.column("shingles").combine_chunks()
                at = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1] // 8
                flat = np.frombuffer(held.buffers()[2], np.uint64, int(at[-1]))
                out: list[tuple[int, int, int | None]] = []
                for a, b in by_group(t):
                    chosen = a + np.unique(reps[a:b], return_index=True)[1]
                    if len(chosen) < 2:
                        continue
                    found = links([flat[at[i] : at[i + 1]] for i in chosen], percent)
                    if whole and found:
                        own, group = reps[chosen], joined(len(chosen), found)
                        least = np.full(len(own), np.iinfo(np.int64).max)
                        np.minimum.at(least, group, own)
                        tied = np.bincount(group, minlength=len(own))[group] > 1
                        out += [(of[a], x, y) for x, y in zip(own[tied], least[group[tied]], strict=True)]
                        continue
                    out += [(of[a], reps[chosen[i]], reps[chosen[j]]) for i, j in found]
                    if many[a] > 1:
                        group = joined(len(chosen), found)
                        first = group[np.searchsorted(reps[chosen], lead[a])]
                        out += [(of[a], reps[i], None) for i, g in zip(chosen, group, strict=True) if g != first]
                columns = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["list", "a", "b"])

        full = met.join(sets, "rep").select("group", "list", "rep", "first", "blocks", "shingles")
        return dealt(full).mapInArrow(arrow(run), "list bigint, a bigint, b bigint")

    if whole:
        one = F.lit(0).alias("first"), F.lit(1).alias("blocks")
        return meet(members.select("list", "rep", *one).withColumn("group", F.col("list"))).select("a", "b")
    placed = members.select("list", "rep").join(wanted.select("rep", "n_shingles"), "rep")
    size = placed.groupBy("list").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"), F.min("rep").alias("first"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    own = cut(placed.join(size, "list").select("list", "rep", "first", "blocks", block.alias("block")))
    firsts = size.where("blocks > 1").select("list", F.col("first").alias("rep"), "first", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = own.unionByName(firsts)
    one = cut(meet(met.withColumn("group", F.xxhash64("list", "block"))))
    alone = one.where(F.col("b").isNull()).select("list", F.col("a").alias("rep")).distinct().join(classes.select("rep", "n_shingles"), "rep")
    parts = alone.groupBy("list").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("parts")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = own.join(parts, "list").select("list", "rep", "first", "blocks", "block", every("parts").alias("part"))
    right = alone.select("list", "rep").join(parts, "list").join(size, "list").select("list", "rep", "first", "blocks", every("blocks").alias("block"), part.alias("part"))
    two = meet(left.unionByName(right).withColumn("group", F.xxhash64(F.lit(2), "list", "block", "part")))
    return one.unionByName(two).where(F.col("b").isNotNull()).select("a", "b")


def joined(n: int, found: list[tuple[int, int]]) -> np.ndarray:
    """The group of each of n members under links."""
    group = np.arange(n)
    for i, j in found:
        group[group == group[j]] = group[i]
    return group


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge reaches."""
    both = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct())
    labels = cut(both.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut(lower.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = new.select("id", "component")
        if new.where(F.col("old") != F.col("component")).isEmpty():
            return labels


def placed(docs: DataFrame, words: int, percent: int, key: str, text: str, deviations: float | None) -> DataFrame:
    """(doc, text_hash, n_shingles, group, first) of every row: the group's number and its smallest key, null for the empty set."""
    threshold = percent / 100
    rows = cut(sketch(docs, words, key, text))
    full = rows.where(F.col("class").isNotNull() & F.col("doc").isNotNull())
    classes = cut(full.groupBy("class").agg(F.min("doc").alias("doc"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("regs").alias("regs")))
    classes = classes.withColumn("rep", F.monotonically_increasing_id())
    members = cut(likely_members(lists(band_rows(classes, rows_per_band(threshold))), classes, threshold, deviations))
    # what lists connect is a cluster; one that a task can hold is met whole, each of its sets there once
    firsts = members.groupBy("list").agg(F.min("rep").alias("b"))
    # each class and the first members of its lists (one a band at most) lead to the least of them
    led = members.join(firsts, "list").groupBy("rep").agg(F.min("b").alias("b"), F.collect_set("b").alias("all"))
    edges = led.select(F.explode(F.array_union("all", F.array("rep"))).alias("a"), "b").where("a != b").distinct()
    clusters = components(edges).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    sizes = clusters.join(classes.select("rep", "n_shingles"), "rep").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"))
    fits = (F.col("n") <= BLOCK) & (F.col("m") * 8 <= BLOCK_BYTES)
    placed_in = cut(clusters.join(sizes.select("cluster", fits.alias("fits")), "cluster"))
    whole = placed_in.where("fits").select(F.col("cluster").alias("list"), "rep")
    # no link leaves a cluster: in one that is met whole, links lead straight to the smallest member they reach
    found = cut(confirmed(whole, classes, docs, words, percent, key, text, whole=True)).select(F.col("a").alias("id"), F.col("b").alias("component"))
    members = members.join(placed_in.where("not fits").select("rep"), "rep", "left_semi")
    if not members.isEmpty():
        found = found.unionByName(by_lists(cut(members), classes, docs, words, percent, key, text))
    of_class = classes.select("class", "rep", "doc").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    smallest = of_class.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc").alias("first"))
    of_class = of_class.join(smallest, "component", "left").select("class", F.coalesce("component", "rep").alias("group"), F.coalesce("first", "doc").alias("first"))
    own = ("doc", "text_hash", "n_shingles")
    empty = rows.where(F.col("class").isNull() | F.col("doc").isNull()).select(*own, F.lit(None).cast("long").alias("group"), F.lit(None).cast(docs.schema[key].dataType).alias("first"))
    return full.join(of_class, "class").select(*own, "group", "first").unionByName(empty)


def by_lists(members: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """(id, component) of the members of clusters that no task holds: each class is met in its largest list first."""
    largest = members.groupBy("rep").agg(F.max(F.struct("n", "list")).alias("l")).select("rep", F.col("l.list").alias("list"))
    first = cut(confirmed(largest, classes, docs, words, percent, key, text))
    found = components(first)
    # then in the lists that were not met whole and hold members of two groups
    met = largest.groupBy("list").agg(F.count(F.lit(1)).alias("met"))
    of = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("list", "rep", F.coalesce("component", "rep").alias("component"))
    rest = of.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("one"), F.max("component").alias("two")).join(met, "list", "left")
    rest = rest.where((F.col("one") != F.col("two")) & (F.coalesce("met", F.lit(0)) < F.col("n"))).select("list")
    more = cut(members.join(rest, "list", "left_semi").select("list", "rep"))
    return found if more.isEmpty() else components(first.unionByName(confirmed(more, classes, docs, words, percent, key, text)))


def groups(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", deviations: float | None = 6.0) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest key that links reach) and ``kept`` of every row.

    Documents link if 100 * shared shingles >= percent * shingles in either.
    """
    rows = placed(docs, words, percent, key, text, deviations)
    component = F.coalesce("first", "doc").alias("component_id")
    return rows.select(F.col("doc").alias(key), "n_shingles", component).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", deviations: float | None = 6.0) -> DataFrame:
    """The rows of ``docs`` without those that a group has beside its smallest key's; rows without a word or a key all stay."""
    best = placed(docs, words, percent, key, text, deviations).where(F.col("group").isNotNull()).groupBy("group").agg(F.min(F.struct("doc", "text_hash")).alias("best")).select("best.*")
    told = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("word"))
    once = told.where("word").join(best, ["doc", "text_hash"]).groupBy("doc", "text_hash").agg(F.any_value("row").alias("row"))
    return once.select("row.*").unionByName(told.where("not word or doc is null").select("row.*"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) IS NULL OR len(ws) = 0 THEN []::VARCHAR[]
                      WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS sh
  FROM w),
d AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.g IN (SELECT g FROM e GROUP BY g HAVING count(*) > 1) GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN d m ON m.doc_id = x JOIN d n ON n.doc_id = y
  WHERE 100 * c >= 85 * (m.n_shingles + n.n_shingles - c)),
k AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id)
"""
