"""Language-model scoring by context-tree weighting over bytes.

A text is its tokens (words after lower-casing A-Z, then one end) joined by one
space and closed by a line feed.  Each byte is eight binary decisions, and each
decision has a Krichevsky-Trofimov estimator in every context of 0 to ``depth``
preceding bytes.  The weighted probability of a context is half its own
estimate and half the product of its children; these weights, taken over the
whole training corpus, mix the estimates of all depths.

Estimates depend on counts alone, so training is one count of byte n-grams over
all training texts.  All contexts are kept: the n-grams of training and of the
texts to score form one table, partitioned by the last ROOT bytes of the
context.  Each partition sums its part of the tree upwards, the driver joins
the parts at contexts of fewer bytes (at most 255 decisions for each of
256 ** (ROOT - 1) contexts, whatever the corpus holds), and each partition mixes downwards and gives every n-gram its
log10 P(byte | context), which is joined back to the chunks of text that have it.
Chunks are bounded by bytes and by rows.  A row goes to the chunk of its hash;
copies of a row (same key and text) that would fill a good part of a chunk are
dealt over several, by the partition they are read from.  Each step is written to
the shared folder, and its shuffles go with its end, so that the disk holds the
shuffles of one step at a time.

The base score is an add-one unigram over tokens.  Frequent tokens, at most
``max_frequent``, are looked up in a broadcast table; all others are joined.

Cases: null text is the empty text, which holds the end alone; texts of any
length are read whole; repeated rows get equal results; an empty table gives an
empty result; without training rows every byte costs eight bits and no token is
known; a null key is not held out; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER_ASCII, arrow, cut, slices, whole_groups

END = b"\n"
FOLD = bytes(LOWER_ASCII.get(i, i) for i in range(256))
#: Entries of a task's counters before they are handed on.
FLUSH = 400_000
#: Bytes of context by which the tree is partitioned; n-grams of a partition that are worked on at once; bytes of text in a chunk.
ROOT, RUN, CHUNK = 3, 200_000, 32 << 20
#: Rows in a chunk; rows whose copies are dealt over several chunks, at most.
CHUNK_ROWS, MAX_HOT = 100_000, 1_000_000
#: Bytes of text that are worked on at once.
SLICE = 2 << 20


def tokens(text: str | None) -> list[bytes]:
    """Words of a text; bytes.split() parts at the same six bytes as the corpus word rule."""
    return (text or "").encode().translate(FOLD).split()


def grams(joined: list[bytes], depth: int) -> np.ndarray:
    """For every byte of the texts its depth preceding bytes and itself as one integer (depth 7 at most); texts begin after ends."""
    flat = np.frombuffer(b"".join([bytes(7 - depth), *(END * depth + t for t in joined)]), np.uint8)
    if len(flat) < 8:
        return np.empty(0, np.int64)
    code = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, 8)).view(">i8").ravel().astype(np.int64) & ((1 << 8 * (depth + 1)) - 1)
    real = np.ones(len(code), bool)
    starts = np.cumsum([len(t) + depth for t in joined[:-1]], dtype=np.int64)
    for k in range(depth):  # positions that lie in the padding of the next text
        real[starts - depth + k] = False
    return code[real]


def distinct(codes: np.ndarray) -> np.ndarray:
    """Distinct codes in order, by a plain sort: np.unique hashes integers, which takes some four times as long here."""
    codes = np.sort(codes)
    return codes[np.append(True, codes[1:] != codes[:-1])[: len(codes)]]


def summed(codes: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their numbers."""
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, where = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(where, weights=np.concatenate(numbers), minlength=len(found)).astype(np.int64)


def counts(docs: DataFrame, depth: int, text: str = "text") -> DataFrame:
    """(word, code, n): tokens with a null code, byte n-grams with a null word, over all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        codes: list[np.ndarray] = []
        numbers: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            found, times = summed(codes, numbers)
            n, m = len(words), len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), pa.nulls(n, pa.int64()), pa.array(words.values(), pa.int64())], ["word", "code", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), pa.array(found), pa.array(times)], ["word", "code", "n"])

        for batch in batches:
            for part in slices(batch, 0, SLICE):
                split = [tokens(t) for t in part.column(0).to_pylist()]
                for own in split:
                    words.update(own)
                words[END] += len(split)
                more, times = np.unique(grams([b" ".join(w) + END for w in split], depth), return_counts=True)
                codes.append(more)
                numbers.append(times)
                if sum(map(len, codes)) > 5 * FLUSH:
                    found, times = summed(codes, numbers)
                    codes[:], numbers[:] = [found], [times]
                if len(words) > FLUSH or sum(map(len, codes)) > 3 * FLUSH and len(codes) == 1:
                    yield from out()
                    words.clear()
                    codes.clear()
                    numbers.clear()
        yield from out()

    rows = docs.select(text).mapInArrow(arrow(run), "word binary, code bigint, n bigint")
    return rows.groupBy("word", "code").agg(F.sum("n").alias("n"))


def least_count(df: DataFrame, n: str, most: int) -> int:
    """A count that at most ``most`` rows reach, from a histogram of powers of two (in eighths)."""
    steps = {r["step"]: r["rows"] for r in df.groupBy(F.floor(F.log2(n) * 8).alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    total, least = 0, max(steps, default=0) + 1
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > most:
            break
        least = step
    return math.ceil(2 ** (least / 8) * (1 - 1e-12))


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0, by Stirling's series from x + 8 on."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - math.log(math.pi) - lgamma(a + b + 1)


@dataclass
class Level:
    """The decisions on one bit of the next byte: keys (context, bits before), counts and products of children, by context depth."""

    keys: list[np.ndarray]
    ups: list[np.ndarray]
    p: list[np.ndarray]
    beta: list[np.ndarray]
    above: np.ndarray


def climb(bit: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray, low: int, high: int, product: np.ndarray | None = None) -> Level:
    """Sum from contexts of ``high`` bytes up to ``low``; without ``product`` the deepest have no children."""
    all_keys, ups, ps, betas = [keys], [], [], []
    for k in range(high, low - 1, -1):
        own = block(a, b)
        ps.append((b + 0.5) / (a + b + 1))
        betas.append(np.ones(len(own)) if product is None else 1 / (1 + np.exp(np.clip(product - own, -700, 700))))
        above = own if product is None else np.logaddexp(own, product) - math.log(2)
        if k > low:
            keys, up = np.unique(keys & ((1 << 8 * (k - 1) + bit) - 1), return_inverse=True)
            a, b, product = (np.bincount(up, x, len(keys)) for x in (a, b, above))
            all_keys.append(keys)
            ups.append(up)
    return Level(all_keys, ups, ps, betas, above)


def descend(level: Level, mixed: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixtures and the weight that is left at the deepest contexts, from those above the highest."""
    for i in range(len(level.p) - 1, -1, -1):
        mixed, weight = mixed + weight * level.beta[i] * level.p[i], weight * (1 - level.beta[i])
        if i:
            mixed, weight = mixed[level.ups[i - 1]], weight[level.ups[i - 1]]
    return mixed, weight


def part_levels(code: np.ndarray, n: np.ndarray, depth: int, root: int) -> Iterator[tuple[int, Level, np.ndarray]]:
    """Of each bit, its level from depth up to root, and the place of each n-gram in the deepest keys."""
    for bit in range(8):
        keys, where = np.unique(code >> (8 - bit), return_inverse=True)
        one = (code >> (7 - bit)) & 1
        yield bit, climb(bit, keys, np.bincount(where, n * (1 - one), len(keys)), np.bincount(where, n * one, len(keys)), root, depth), where


def gram_scores(spread: DataFrame, depth: int) -> DataFrame:
    """(code, log10p, chunks) of all n-grams (root, code, n, chunks), which lie together by root and in its order.

    A logarithm travels in single precision, to a relative 1e-7 of itself; sums are made in double precision.
    """
    root = min(ROOT, depth)

    def upwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "root", RUN):
            for bit, level, where in part_levels(t.column("code").to_numpy(), t.column("n").to_numpy(), depth, root):
                one = (t.column("code").to_numpy() >> (7 - bit)) & 1
                n = t.column("n").to_numpy()
                top = level.keys[-1] & ((1 << 8 * (root - 1) + bit) - 1)
                keys, up = np.unique(top, return_inverse=True)
                for x in level.ups:
                    where = x[where]
                a, b = (np.bincount(up[where], n * y, len(keys)) for y in (1 - one, one))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), bit, np.int32)), pa.array(keys), pa.array(a), pa.array(b), pa.array(np.bincount(up, level.above, len(keys)))], ["bit", "key", "a", "b", "product"])

    sums = spread.select("root", "code", "n").mapInArrow(arrow(upwards), "bit int, key bigint, a double, b double, product double")
    top = sums.groupBy("bit", "key").agg(*(F.sum(c).alias(c) for c in ("a", "b", "product"))).orderBy("bit", "key").toArrow()
    bits, *columns = (top.column(k).to_numpy() for k in range(5))
    mixtures = []
    for bit in range(8):
        keys, a, b, product = (c[bits == bit] for c in columns)
        if not len(keys):
            continue
        level = climb(bit, keys, a, b, 0, root - 1, product)
        n = len(level.keys[-1])
        mixtures.append((keys, *descend(level, np.zeros(n), np.ones(n))))
    shared = spread.sparkSession.sparkContext.broadcast(mixtures)

    def downwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "root", RUN):
            code = t.column("code").to_numpy()
            total = np.zeros(len(code))
            for bit, level, where in part_levels(code, t.column("n").to_numpy(), depth, root):
                keys, mixed, weight = shared.value[bit]
                at = np.searchsorted(keys, level.keys[-1] & ((1 << 8 * (root - 1) + bit) - 1))
                one = np.clip(descend(level, mixed[at], weight[at])[0], 1e-12, 1 - 1e-7)[where]
                total += np.log10(np.where((code >> (7 - bit)) & 1, one, 1 - one))
            yield from pa.table({"code": t.column("code"), "log10p": total.astype(np.float32), "chunks": t.column("chunks")}).combine_chunks().to_batches(20_000)

    return spread.mapInArrow(arrow(downwards), "code bigint, log10p float, chunks array<int>")


def hot_rows(docs: DataFrame, key: str, text: str) -> tuple[int, dict[int, int]]:
    """The number of chunks, and of rows (by hash) with copies that fill an eighth of a chunk or more the number of chunks for them."""
    row = F.xxhash64(key, text).alias("hash")
    sizes = cut(docs.select(row, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("size")).groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("size")), release=True)
    size, rows = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    share = F.greatest(F.col("size") / max(CHUNK, 8 * size / MAX_HOT), F.col("copies") / max(CHUNK_ROWS, 8 * rows / MAX_HOT))
    # each takes an eighth of a chunk at least, and an eighth of all rows or bytes over MAX_HOT: so at most 2 * MAX_HOT of them
    hot = sizes.where((F.col("copies") > 1) & (share >= 1 / 8)).select("hash", F.least("copies", F.ceil(8 * share)).alias("parts"))
    return max(size // CHUNK, rows // CHUNK_ROWS) + 1, {r["hash"]: r["parts"] for r in hot.collect()}


def deal(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (chunk, key, text), and rows whose texts hold all n-grams that those of each chunk have."""
    chunks, hot = hot_rows(docs, key, text)
    chunk = lambda *salt: F.pmod(F.xxhash64(key, text, *salt), F.lit(chunks)).cast("int").alias("chunk")
    read = placed = docs.select(chunk(), key, text)
    if hot and chunks > 1:
        listed = docs.sparkSession.createDataFrame(list(hot.items()), "hash bigint, parts bigint")
        marked = docs.select(F.xxhash64(key, text).alias("hash"), key, text).join(F.broadcast(listed), "hash", "left")
        # any copy may go to any chunk of its row, as the n-grams of the row are read for all of them
        placed = marked.select(F.when(F.col("parts").isNull(), chunk()).otherwise(chunk(F.pmod(F.hash(F.spark_partition_id()), "parts"))).alias("chunk"), key, text)
        once = marked.where("parts is not null").groupBy(key, text).agg(F.max("parts").alias("parts"))
        salted = once.select(key, text, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("salt")).select(chunk(F.col("salt")), key, text)
        read = marked.where("parts is null").select(chunk(), key, text).unionByName(salted)
    return placed, read


@dataclass
class Model:
    #: counts of frequent tokens; ``rare`` holds the others as a DataFrame (word, c)
    frequent: dict[bytes, int]
    rare: DataFrame
    train_tokens: int
    distinct: int
    depth: int
    #: (code, n): all byte n-grams of training
    codes: DataFrame


def fit(training: DataFrame, depth: int = 5, max_frequent: int = 100_000, text: str = "text") -> Model:
    """Counts of tokens and byte n-grams over all training rows; ``depth`` is 1 to 7."""
    if not 1 <= depth <= 7:
        raise ValueError("depth must be 1 to 7")
    table = cut(counts(training, depth, text), release=True)
    words = table.where(F.col("word").isNotNull()).select("word", F.col("n").alias("c"))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = least_count(words, "c", max_frequent)
    frequent = words.where(F.col("c") >= least).toArrow()
    known = dict(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist(), strict=True))
    return Model(known, words.where(F.col("c") < least), int(n), int(v), depth, table.where(F.col("code").isNotNull()).select("code", "n"))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` (log10) and ``bits_per_byte`` (the code length) of every row."""
    shared, depth = docs.sparkSession.sparkContext.broadcast(model.frequent), model.depth
    pairs = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))
    names = [key, "n_tokens", "known", "logs", "score", "n_bytes", "others"]
    types = [to_arrow_type(docs.schema[key].dataType), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pairs]
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, known bigint, logs double, score double, n_bytes bigint, others array<struct<word: binary, times: int>>"
    placed, read = deal(docs, key, text)

    def texts_of(t: pa.Table, *columns: str) -> Iterator[pa.RecordBatch]:
        return (part for batch in t.select([*columns, text]).to_batches() if batch.num_rows for part in slices(batch, len(columns), SLICE))

    def seen_grams(t: pa.Table) -> pa.Table:
        seen = [distinct(grams([b" ".join(tokens(x)) + END for x in part.column(1).to_pylist()], depth)) for part in texts_of(t, "chunk")]
        codes = distinct(np.concatenate(seen))
        return pa.table({"code": codes, "chunk": pa.array(np.full(len(codes), t.column("chunk")[0].as_py(), np.int32))})

    def base(own: list[bytes], frequent: dict[bytes, int]) -> tuple[int, float, list[dict]]:
        """Frequent tokens, the sum of their logs, and all other tokens."""
        known, total, others = 0, 0.0, []
        for w, times in [*Counter(own).items(), (END, 1)]:
            if (c := frequent.get(w)) is None:
                others.append({"word": w, "times": times})
            else:
                total += times * math.log10(c + 1)
                known += times
        return known, total, others

    def run(t: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(codes := found.column("code").to_numpy())
        codes, log10p, out = codes[order], found.column("log10p").to_numpy()[order], []
        for part in texts_of(t, key):
            split = [tokens(x) for x in part.column(1).to_pylist()]
            joined = [b" ".join(w) + END for w in split]
            lengths = np.array([len(x) for x in joined])
            asked, where = np.unique(grams(joined, depth), return_inverse=True)
            scores = np.add.reduceat(log10p[np.searchsorted(codes, asked)].astype(np.float64)[where], np.cumsum(lengths) - lengths)
            known, logs, others = zip(*(base(w, shared.value) for w in split), strict=True)
            columns = [part.column(0), [len(w) + 1 for w in split], known, logs, scores, lengths, others]
            out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, types, strict=True)], names))
        return pa.Table.from_batches(out, pa.schema(list(zip(names, types, strict=True))))

    mine = read.groupBy("chunk").applyInArrow(seen_grams, "code bigint, chunk int").select("code", F.lit(0).cast("bigint").alias("n"), "chunk")
    both = mine.unionByName(model.codes.withColumn("chunk", F.lit(None).cast("int"))).groupBy("code").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks"))
    top = F.shiftright("code", 8).bitwiseAND((1 << 8 * min(ROOT, depth)) - 1).alias("root")
    spread = cut(both.select(top, "code", "n", "chunks").repartition("root").sortWithinPartitions("root", "code"), release=True)
    told = gram_scores(spread, depth).select(F.explode("chunks").alias("chunk"), "code", "log10p")
    walked = cut(placed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema), release=True).withColumn("row", F.monotonically_increasing_id())
    walked_pairs = walked.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.times")
    log: Column = F.log10(F.col("c") + 1)
    more = walked_pairs.join(model.rare, "word").groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum("times").alias("also"))
    base_score = F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(model.train_tokens + model.distinct + 1)
    known = (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known")
    bits = (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte")
    return walked.drop("others").join(more, "row", "left").select(key, "n_tokens", known, base_score.alias("base_score"), "score", bits)
