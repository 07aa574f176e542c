"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary.

One edit leaves a half of the shorter word intact: its first half stands in
both words' beginnings, or its second half in both words' ends.  So each word
goes, with its own length m and with m less one, to the block of its first half
(forward dictionary) and to that of its last half (reversed dictionary).  A
dictionary is range-partitioned and sorted by block, and each task scans the
runs of its range.

A block that is too large is divided further: what its words don't share yet
has one edit again, which leaves a half of that intact.  A block is (m, a, b):
words of m or m + 1 letters that share their first a and last b.  Where one
letter is left open a block holds at most all one- and two-letter middles, so
division ends however many words share a beginning.  A pair is kept only in the
one block to which its longest common prefix leads, so none is found twice.
Blocks beyond LARGE are divided by Spark before the dictionary is sorted, those
beyond SMALL in the task that holds them; then pairs of a block are verified,
all blocks of a batch at once.

Cases: null and empty texts have no words; a null key counts as an empty key;
repeated rows count each time; texts and words of any length are read whole;
ties go to the word that is smaller in code-point order; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, slices, whole_groups

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF, so a word is one byte a letter in Latin-1.
LETTERS = r"A-Za-zÀ-ÿ"
#: Words of a block beyond which Spark divides it, and beyond which its task does.
LARGE, SMALL = 50_000, 24
#: Distinct words that a counting task holds before it hands them on.
HELD = 200_000
#: Bytes of word pairs that are compared at once.
COMPARED = 8 << 20
#: Bytes of letters and hashes that are held at once.
MATRIX = 128 << 20
#: Odd multiplier of the rolling hashes that group words; a collision only makes a block larger.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, slip: int = 31) -> DataFrame:
    """(word, n) of the lower-cased words of ``shortest`` letters or more that occur ``least`` times.

    A word of a document loses the letter number h mod length where ``slip`` divides h, the crc32 of key and word.
    """
    found = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, 1):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not t:
                        continue
                    start = zlib.crc32(f"{k or ''}:".encode())
                    for word, n in Counter(found.findall(t.encode().lower().decode())).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                        held[word] += n
                if len(held) > HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))
                    held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = docs.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")).mapInArrow(arrow(run), "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def block_key(m: Column, a: Column, b: Column) -> Column:
    """What the words of a block share; blocks of the reversed dictionary begin with the word's end, reversed."""
    return F.concat_ws(":", m, a, b, F.substring("word", F.lit(1), a), F.substring(F.reverse("word"), F.lit(1), b))


def halves(entries: DataFrame) -> DataFrame:
    """Entries (word, n, m, a, b) in both blocks that share half more of what is open; where one letter is open there are none."""
    rest = F.expr("m - a - b")
    longer = F.struct((F.col("a") + F.floor(rest / 2)).cast("int").alias("a"), F.col("b").alias("b"))
    last = F.struct(F.col("a").alias("a"), (F.col("b") + F.ceil(rest / 2)).cast("int").alias("b"))
    both = entries.select("word", "n", "m", F.explode(F.array(longer, last)).alias("s")).select("word", "n", "m", "s.a", "s.b")
    return both.withColumn("block", block_key(F.col("m"), F.col("a"), F.col("b")))


def blocks(counted: DataFrame, large: int = LARGE) -> DataFrame:
    """Entries (word, n, m, a, b, block) of both dictionaries; no block has more than ``large`` words that can still be divided."""
    letters = F.length("word")
    level = halves(counted.select("word", "n", F.explode(F.array(letters, letters - 1)).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b")).where("m > 0"))
    done: list[DataFrame] = []
    while True:
        sizes = cut(level.where("m - a - b > 1").groupBy("block").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > large).select("block"))
        if not (many := sizes.count()):
            break
        sizes = F.broadcast(sizes) if many <= 10_000 else sizes
        done.append(level.join(sizes, "block", "left_anti"))
        level = halves(level.join(sizes, "block", "left_semi").drop("block"))
    for more in done:
        level = level.unionByName(more)
    return level


class Batch:
    """Entries whose words have ``m`` or ``m`` + 1 letters, as one matrix of letters with rolling hashes of their beginnings."""

    def __init__(self, m: int, spelled: list[bytes]) -> None:
        self.m, self.size = m, np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.letters = np.frombuffer(b"".join(w.ljust(m + 1, b"\0") for w in spelled), np.uint8).reshape(-1, m + 1)
        self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m + 1, MULTIPLIER))])
        self.hashes = np.zeros((len(spelled), m + 2), np.uint64)
        np.cumsum((self.letters + np.uint64(1)) * self.powers[: m + 1], axis=1, out=self.hashes[:, 1:])

    def part(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of letters start to end of each row; equal parts at different places have equal ones."""
        return (self.hashes[rows, end] - self.hashes[rows, start]) * self.powers[self.m + 1 - start]

    def near(self, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True for pairs one edit apart whose place is the block (a, b)."""
        out = np.zeros(len(i), bool)
        step = max(1, COMPARED // (self.m + 1))
        for k in range(0, len(i), step):
            own = slice(k, k + step)
            x, y = i[own], j[own]
            swap = self.size[x] > self.size[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            longer = self.size[y] - self.size[x]
            p, q = self.letters[x], self.letters[y]
            same = p == q
            same[:, -1] = False
            first = same.argmin(1)
            # from the end: letter t of the shorter word against letter t + longer of the other
            moved = np.where(longer[:, None] == 1, p[:, : self.m] == q[:, 1:], same[:, : self.m])[:, ::-1]
            last = np.where(moved.all(1), self.m, moved.argmin(1))
            told = (self.size[x] == self.m) & (first + last >= self.m - (longer == 0)) & (first >= a[own]) & (last >= b[own])
            out[own] = told & ((b[own] == 0) | (first < self.m - b[own]))
        return out


def pairs_of(batch: Batch, block: np.ndarray, a: np.ndarray, b: np.ndarray, small: int = SMALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows one edit apart; blocks of more than ``small`` rows are divided first."""
    rows = np.arange(len(block))
    while len(rows):
        _, block, size = np.unique(block, return_inverse=True, return_counts=True)
        size = size[block]
        rest = batch.m - a - b
        ready = (size > 1) & ((size <= small) | (rest <= 1))
        order = np.flatnonzero(ready)
        order = order[np.lexsort((batch.size[rows[order]], block[order]))]
        starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]) if len(order) else order
        ends = np.repeat(np.r_[starts[1:], len(order)], np.diff(np.r_[starts, len(order)])) if len(order) else order
        # each word of m letters meets those behind it; the longer ones stand last and need not meet each other
        after = np.where(batch.size[rows[order]] == batch.m, ends - np.arange(len(order)) - 1, 0)
        for lo, hi in _runs(after):
            i = np.repeat(np.arange(lo, hi), after[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi])
            x, y = order[i], order[j]
            held = batch.near(rows[x], rows[y], a[x], b[x])
            yield rows[x[held]], rows[y[held]]
        open_ = (size > small) & (rest > 1)
        r, ra, rb, of, half = rows[open_], a[open_], b[open_], block[open_].astype(np.uint64), rest[open_] // 2
        left = batch.part(r, ra, ra + half)
        end = batch.size[r] - rb
        right = batch.part(r, end - (rest[open_] - half), end)
        rows = np.concatenate([r, r])
        a, b = np.concatenate([ra + half, ra]), np.concatenate([rb, rb + rest[open_] - half])
        block = np.concatenate([(left ^ of * MULTIPLIER) << np.uint64(1), (right ^ of * MULTIPLIER) << np.uint64(1) | np.uint64(1)])


def _runs(after: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` pairs each."""
    total, lo = np.cumsum(after), 0
    while lo < len(after):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right"))
        yield lo, (hi := max(hi, lo + 1))
        lo = hi


def near_words(held: pa.Table, small: int = SMALL) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best): for each word of a table of whole blocks, its near words in it and the best of them."""
    held = held.combine_chunks()
    lengths, n, a, b = (held.column(c).to_numpy() for c in ("m", "n", "a", "b"))
    block = held.column("block").chunk(0).dictionary_encode().indices.to_numpy()
    for m in np.unique(lengths).tolist():
        for at in _whole_blocks(np.flatnonzero(lengths == m), block, MATRIX // ((m + 2) * 9)):
            spelled = [w.encode("latin-1") for w in held.column("word").take(pa.array(at)).to_pylist()]
            found = list(pairs_of(Batch(m, spelled), block[at], a[at].astype(np.int64), b[at].astype(np.int64), small))
            i, j = (np.concatenate([p[k] for p in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            if not len(i):
                continue
            # words as numbers in code-point order, which is the order of their bytes in Latin-1
            names, number = np.unique(np.array(spelled), return_inverse=True)
            counts = np.zeros(len(names), np.int64)
            counts[number] = n[at]
            x, y = np.concatenate([number[i], number[j]]), np.concatenate([number[j], number[i]])
            order = np.lexsort((y, -counts[y], x))
            x, y = x[order], y[order]
            heads = np.flatnonzero(np.r_[True, np.diff(x) != 0])
            tell = lambda k: pa.array([w.decode("latin-1") for w in names[k].tolist()], pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([tell(x[heads]), pa.array(np.diff(np.r_[heads, len(x)]), pa.int64()), pa.array(counts[y[heads]], pa.int64()), tell(y[heads])], ["word", "n_near", "best_n", "best"])


def _whole_blocks(rows: np.ndarray, block: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows in parts of about ``most`` that hold whole blocks."""
    rows = rows[np.argsort(block[rows], kind="stable")]
    ends = np.flatnonzero(np.r_[np.diff(block[rows]) != 0, True]) + 1
    lo = 0
    while lo < len(rows):
        hi = int(ends[np.searchsorted(ends, min(lo + max(most, 1), len(rows)))])
        yield rows[lo:hi]
        lo = hi


def near(self, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True for pairs one edit apart whose place is the block (a, b)."""
        out = np.zeros(len(i), bool)
        step = max(1, COMPARED // (self.m + 1))
        for k in range(0, len(i), step):
            own = slice(k, k + step)
            x, y = i[own], j[own]
            swap = self.size[x] > self.size[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            longer = self.size[y] - self.size[x]
            p, q = self.letters[x], self.letters[y]
            same = p == q
            same[:, -1] = False
            first = same.argmin(1)
            # from the end: letter t of the shorter word against letter t + longer of the other
            moved = np.where(longer[:, None] == 1, p[:, : self.m] == q[:, 1:], same[:, : self.m])[:, ::-1]
            last = np.where(moved.all(1), self.m, moved.argmin(1))
            told = (self.size[x] == self.m) & (first + last >= self.m - (longer == 0)) & (first >= a[own]) & (last >= b[own])
            out[own] = told & ((b[own] == 0) | (first < self.m - b[own]))
        return out


def pairs_of(batch: Batch, block: np.ndarray, a: np.ndarray, b: np.ndarray, small: int = SMALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows one edit apart; blocks of more than ``small`` rows are divided first."""
    rows = np.arange(len(block))
    while len(rows):
        _, block, size = np.unique(block, return_inverse=True, return_counts=True)
        size = size[block]
        rest = batch.m - a - b
        ready = (size > 1) & ((size <= small) | (rest <= 1))
        order = np.flatnonzero(ready)
        order = order[np.lexsort((batch.size[rows[order]], block[order]))]
        starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]) if len(order) else order
        ends = np.repeat(np.r_[starts[1:], len(order)], np.diff(np.r_[starts, len(order)])) if len(order) else order
        # each word of m letters meets those behind it; the longer ones stand last and need not meet each other
        after = np.where(batch.size[rows[order]] == batch.m, ends - np.arange(len(order)) - 1, 0)
        for lo, hi in _runs(after):
            i = np.repeat(np.arange(lo, hi), after[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi])
            x, y = order[i], order[j]
            held = batch.near(rows[x], rows[y], a[x], b[x])
            yield rows[x[held]], rows[y[held]]
        open_ = (size > small) & (rest > 1)
        r, ra, rb, of, half = rows[open_], a[open_], b[open_], block[open_].astype(np.uint64), rest[open_] // 2
        left = batch.part(r, ra, ra + half)
        end = batch.size[r] - rb
        right = batch.part(r, end - (rest[open_] - half), end)
        rows = np.concatenate([r, r])
        a, b = np.concatenate([ra + half, ra]), np.concatenate([rb, rb + rest[open_] - half])
        block = np.concatenate([(left ^ of * MULTIPLIER) << np.uint64(1), (right ^ of * MULTIPLIER) << np.uint64(1) | np.uint64(1)])


def _runs(after: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` pairs each."""
    total, lo = np.cumsum(after), 0
    while lo < len(after):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right"))
        yield lo, (hi := max(hi, lo + 1))
        lo = hi


def near_words(held: pa.Table, small: int = SMALL) -> Iterator[pa.RecordBatch]:
    """(word, n_near, n, best): for each word of a table of whole blocks, its near words in it and the best of them."""
    lengths = held.column("m").to_numpy()
    keys = held.column("block").combine_chunks().dictionary_encode()
    blocks_, a, b = (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).indices.to_numpy(), held.column("a").to_numpy(), held.column("b").to_numpy()
    n = held.column("n").to_numpy()
    for m in np.unique(lengths):
        own = np.flatnonzero(lengths == m)
        for at in np.array_split(own, 1) if len(own) * (int(m) + 2) * 9 <= 1 << 28 else _by_block(own, blocks_, int(m)):
            spelled = [w.encode("latin-1") for w in held.column("word").take(pa.array(at)).to_pylist()]
            found = list(pairs_of(Batch(int(m), spelled), blocks_[at], a[at].astype(np.int64), b[at].astype(np.int64), small))
            i, j = (np.concatenate([p[k] for p in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            if not len(i):
                continue
            # words as numbers in code-point order, which is the order of their bytes here
            names, number = np.unique(np.array(spelled, dtype=object), return_inverse=True)
            counts = np.zeros(len(names), np.int64)
            counts[number] = n[at]
            x, y = np.concatenate([number[i], number[j]]), np.concatenate([number[j], number[i]])
            order = np.lexsort((y, -counts[y], x))
            x, y = x[order], y[order]
            heads = np.flatnonzero(np.r_[True, np.diff(x) != 0])
            tell = lambda k: pa.array([names[v].decode("latin-1") for v in k.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([tell(x[heads]), pa.array(np.diff(np.r_[heads, len(x)]), pa.int64()), pa.array(counts[y[heads]], pa.int64()), tell(y[heads])], ["word", "n_near", "best_n", "best"])


def _by_block(rows: np.ndarray, block: np.ndarray, m: int) -> Iterator[np.ndarray]:
    """Rows of very long words, some whole blocks at a time."""
    rows = rows[np.argsort(block[rows], kind="stable")]
    step = max(1, (1 << 28) // ((m + 2) * 9))
    lo = 0
    while lo < len(rows):
        hi = min(lo + step, len(rows))
        while hi < len(rows) and block[rows[hi]] == block[rows[hi - 1]]:
            hi += 1
        yield rows[lo:hi]
        lo = hi


def near(counted: DataFrame, large: int = LARGE, small: int = SMALL) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near word; of equal n the smaller word is best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, "block", most_rows=200_000):
            yield from near_words(held, small)

    dictionary = blocks(counted, large).repartitionByRange("block").sortWithinPartitions("block")
    found = dictionary.select("word", "n", "m", "a", "b", "block").mapInArrow(arrow(run), "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame, most: int, factor: int = 10) -> DataFrame:
    """(word, root) for edges (word, form): the end of each chain.

    Along a chain n grows by ``factor`` at least, so links are at most its logarithm of the largest n, and doubling needs the log2 of that.
    """
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, math.ceil(math.log(max(most, 2), factor)))))):
        step = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = cut(found.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return found


def variants(counted: DataFrame, factor: int = 10, large: int = LARGE, small: int = SMALL) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word; a form has at least ``factor`` (2 or more) times the word's n."""
    counted = cut(counted)
    found = cut(counted.join(near(counted, large, small), "word", "left"))
    other = F.col("best_n") >= factor * F.col("n")
    told = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(other, F.col("best")).alias("form"), F.when(other, F.col("best_n")).alias("form_n"))
    most = counted.agg(F.max("n")).first()[0] or 1
    ends = roots(told.where("form is not null").select("word", "form"), most, factor)
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The words a document is counted with, then pairs by the places of their one edit.  SQL has no crc32: it is summed byte by byte over its table.
ORACLE = """
with recursive table_(i, k, v) as (select cast(i as bigint), 0, cast(i as bigint) from range(256) t(i) union all select i, k + 1, if(v & 1 = 1, xor(v >> 1, 3988292384), v >> 1) from table_ where k < 8),
crc as (select list(v order by i) as t from table_ where k = 8),
runs as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
per_doc as (select id, run, count(*) as n from runs where length(run) >= 7 group by all),
bytes as (select id, run, n, [cast(('0x' || substr(x, 2 * i + 1, 2)) as bigint) for i in range(length(x) // 2)] as b from (select *, hex(encode(id || ':' || run)) as x from per_doc)),
hashed as (select run, n, xor(list_reduce(list_concat([4294967295], b), lambda c, y: xor(t[xor(c & 255, y) + 1], c >> 8)), 4294967295) as h from bytes, crc),
slipped as (select if(h % 31 = 0, substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2), run) as word, n from hashed),
w as (select word, cast(sum(n) as bigint) as n, length(word) as m from slipped where length(word) >= 7 group by word having sum(n) >= 2),
gaps as (select word, n, m, i, substr(word, 1, i) || chr(1) || substr(word, i + 2) as hole, substr(word, 1, i) || substr(word, i + 2) as less from (select *, unnest(range(m)) as i from w)),
near as (
  select x.word, y.word as other, y.n as other_n from gaps x join gaps y on x.hole = y.hole and x.word <> y.word
  union select x.word, w.word, w.n from gaps x join w on x.less = w.word
  union select w.word, x.word, x.n from gaps x join w on x.less = w.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
told as (select w.word, w.n, coalesce(n_near, 0) as n_near, if(other_n >= 10 * n, other, null) as form, if(other_n >= 10 * n, other_n, null) as form_n from w left join best using (word)),
chain(word, head, k) as (select word, word, 0 from told union all select c.word, t.form, k + 1 from chain c join told t on c.head = t.word where t.form is not null),
ends as (select word, arg_max(head, k) as root from chain group by word)
select word, form, root, n, cast(n_near as bigint) as n_near, cast(form_n as bigint) as form_n from told join ends using (word)
"""
