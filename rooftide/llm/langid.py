"""Language identification: word-first backoff.

A known word is scored by its log frequency in each language.  An unseen word
falls back to its character n-grams, from the longest length down: a position
uses the longest n-gram that the model knows.  The language with the highest
sum wins.

The model is fitted on labelled rows picked by a hash, about ``max_documents``
of them (the documented bound of the sample): all rows of small languages, and
of each larger one about as many as fit.  All words and n-grams of the sample
are kept.  Frequencies are mixed with a uniform share over one vocabulary, so
that an unseen word costs the same in each language, however little of it was
seen.  Words and n-grams are told apart by 64-bit hashes, and a model is a few
arrays whose size the sample bounds.

Cases: null text, or text without letters, gives ``und`` with score 0; texts of
any length are read whole; ties go to the smaller language name; repeated rows
get equal results; an empty table or one without labels gives ``und`` for all;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, map_arrow, slices

LETTERS = re.compile(r"[^\W\d_]+")
SIZES = (4, 3, 2, 1)
#: Words and n-grams that a task remembers before it starts afresh; words of more letters than LONG are scored anew each time.
CACHE_WORDS, CACHE_GRAMS, LONG = 80_000, 200_000, 64
#: The share of a uniform choice over the vocabulary in each language's frequencies.
UNIFORM = 0.01
#: Bytes of text that are worked on at once.
SLICE = 1 << 20
#: Seed of Spark's xxhash64.
SEED = 42


@dataclass
class Table:
    """Sorted hashes and one row of log frequencies, a column per language, for each."""

    keys: np.ndarray
    logs: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


@dataclass
class Model:
    """Log frequencies of words and of n-grams (their ends marked) in each language."""

    languages: list[str]
    words: Table
    grams: Table


def hashed(strings: list[str]) -> np.ndarray:
    """The hashes that Spark's xxhash64 gives."""
    return np.fromiter((xxhash.xxh64_intdigest(x.encode(), SEED) for x in strings), np.uint64, len(strings)).view(np.int64)


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked."""
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over all rows, counted within each batch first."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[str]] = defaultdict(Counter)
        for part in slices(batch, 1, SLICE):
            for language, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen[language].update(LETTERS.findall(t.lower()))
        rows = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
        names, words, counts = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

    return map_arrow(docs.select(lang, text), run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fair_share(totals: list[int], most: int) -> int:
    """Rows that each language may give so that all give ``most`` together; smaller ones give all they have."""
    rest = most
    for i, n in enumerate(sorted(totals)):
        share = rest // (len(totals) - i)
        if n > share:
            return max(share, 1)
        rest -= n
    return max(totals, default=0)


def sample(labelled: DataFrame, text: str, lang: str, max_documents: int) -> DataFrame:
    """(text, lang) of about ``max_documents`` rows with a language: all of small languages, at least one row's text of each."""
    hashed = [c for c in labelled.columns if "map<" not in labelled.schema[c].dataType.simpleString()]
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.shiftrightunsigned(F.xxhash64(*hashed), 33).alias("h"))
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()
    share = fair_share([r["n"] for r in totals], max_documents)
    bounds = [(r["lang"], max(r["least"], (1 << 31) * share // r["n"])) for r in totals]
    most = labelled.sparkSession.createDataFrame(bounds, "lang string, most bigint")
    return rows.join(F.broadcast(most), "lang").where("h <= most").select("text", "lang")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_documents: int = 20_000) -> Model:
    """Fit on about ``max_documents`` rows with a language, chosen by :func:`sample`."""
    counts = cut(word_counts(sample(labelled, text, lang, max_documents), "text", "lang"))
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    spans = [F.expr(f"if(length(w) >= {n}, transform(sequence(1, length(w) - {n - 1}), i -> substring(w, i, {n})), array())") for n in SIZES]
    split = counts.select("lang", "n", marked.alias("w")).select("lang", "n", F.explode(F.concat(*spans)).alias("gram"))
    pieces = split.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counts.select("lang", F.lit(0).alias("size"), F.xxhash64("word").alias("h"), "n").unionByName(pieces.select("lang", F.length("gram").alias("size"), F.xxhash64("gram").alias("h"), "n")).toArrow()
    names, size, h, n = (rows.column(k) for k in range(4))
    languages = sorted(set(names.to_pylist()))
    of = np.searchsorted(np.array(languages, dtype=object), np.array(names.to_pylist(), dtype=object)) if languages else np.empty(0, int)
    size, h, n = size.to_numpy(), h.to_numpy(), n.to_numpy()
    tables = [_logs(size[own], h[own], of[own], n[own], len(languages)) for own in (size == 0, size > 0)]
    return Model(languages, *tables)


def _logs(size: np.ndarray, h: np.ndarray, of: np.ndarray, n: np.ndarray, languages: int) -> Table:
    """Log frequencies in all languages, a share of them uniform over the entries of a size."""
    keys, first, at = np.unique(h, return_index=True, return_inverse=True)
    counts = np.zeros((len(keys), languages))
    np.add.at(counts, (at, of), n)
    logs = np.empty((len(keys), languages), np.float64)
    own = size[first]
    for k in np.unique(own):
        rows = own == k
        share = counts[rows] / np.maximum(counts[rows].sum(0), 1)
        logs[rows] = np.log((1 - UNIFORM) * share + UNIFORM / rows.sum())
    return Table(keys, logs)


class Predictor:
    """Predictions of one task; scores of words and rows of n-grams are kept between texts."""

    def __init__(self, model: Model) -> None:
        self.model, self.at, self.gram_rows = model, {}, {}
        self.scores = np.empty((0, len(model.languages)))

    def rows_of(self, found: list[str]) -> np.ndarray:
        """Rows of n-grams in the model, -1 for unknown ones."""
        known = self.gram_rows
        if len(known) > CACHE_GRAMS:
            known.clear()
        fresh = [g for g in set(found) if g not in known]
        known.update(zip(fresh, self.model.grams.find(hashed(fresh)).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def backed_off(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words: the mean over the longest n-gram known at each place, 0 where there is none."""
        places = np.array([len(w) + 2 for w in words])
        start = np.cumsum(places) - places
        best = np.full(int(places.sum()), -1)
        for n in sorted(SIZES):  # longer ones overwrite shorter ones
            many = np.maximum(places - n + 1, 0)
            rows = self.rows_of([g for w in words for g in grams(w, n)])
            at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(len(rows))
            best[at[rows >= 0]] = rows[rows >= 0]
        of, rows = np.repeat(np.arange(len(words)), places)[best >= 0], best[best >= 0]
        out = np.zeros((len(words), len(self.model.languages)))
        np.add.at(out, of, self.model.grams.logs[rows])
        return out / np.maximum(np.bincount(of, minlength=len(words)), 1)[:, None]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Per-language scores of words: a word's own log frequencies, else what it backs off to."""
        at = self.model.words.find(hashed(words))
        out = np.zeros((len(words), len(self.model.languages)))
        out[at >= 0] = self.model.words.logs[at[at >= 0]]
        unseen = np.flatnonzero(at < 0)
        for k in range(0, len(unseen), 5000):
            out[unseen[k : k + 5000]] = self.backed_off([words[i] for i in unseen[k : k + 5000].tolist()])
        return out

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The best language and its posterior for each text."""
        names, posteriors = ["und"] * len(texts), [0.0] * len(texts)
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not self.model.languages:
            return names, posteriors
        if len(self.at) > CACHE_WORDS:
            self.at.clear()
            self.scores = self.scores[:0]
        fresh = [w for w in {w for ws in found for w in ws} if w not in self.at]
        start = len(self.scores)
        self.scores = np.concatenate([self.scores, self.word_scores(fresh)])
        self.at.update(zip(fresh, range(start, start + len(fresh)), strict=True))
        told = [i for i, ws in enumerate(found) if ws]
        if told:
            sizes = np.array([len(found[i]) for i in told])
            rows = np.fromiter((self.at[w] for i in told for w in found[i]), np.int64, int(sizes.sum()))
            sums = np.add.reduceat(self.scores[rows], np.cumsum(sizes) - sizes, 0)
            best = sums.argmax(1)
            share = 1 / np.exp(np.maximum(sums - sums.max(1, keepdims=True), -700)).sum(1)
            for i, k, x in zip(told, best.tolist(), share.tolist(), strict=True):
                names[i], posteriors[i] = self.model.languages[k], x
        if any(len(w) > LONG for w in fresh):
            self.at.clear()
            self.scores = self.scores[:0]
        return names, posteriors


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``lang_pred`` (a learned language or ``und``), ``score`` (the winner's posterior) and the columns in ``keep`` as ``kept_*``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = list(dict.fromkeys([key, text, *keep]))
    at = [read.index(c) for c in (key, *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Predictor(shared.value)
        for batch in batches:
            for part in slices(batch, read.index(text), SLICE):
                names, scores = told(part.column(read.index(text)).to_pylist())
                kept = [part.column(i) for i in at]
                yield pa.RecordBatch.from_arrays([kept[0], pa.array(names, pa.string()), pa.array(scores, pa.float64()), *kept[1:]], [key, "lang_pred", "score", *(f"kept_{c}" for c in keep)])

    kind = lambda c: docs.schema[c].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind(key)}, lang_pred string, score double", *(f"`kept_{c}` {kind(c)}" for c in keep)])
    return docs.select(*read).mapInArrow(arrow(run), schema)
