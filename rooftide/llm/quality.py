"""Document quality by a linear-chain conditional random field over lines.

Every line is good (1) or bad (0).  A line's score comes from features of its
own and of the lines before and after it; neighbouring labels have a score too.
The marginal probability that a line is good, by forward-backward over the
whole document, is averaged with the lines' lengths as weights: that is the
document's score.

Only whole documents carry labels, so in training each line takes its
document's label.  The model is fitted on at most ``max_documents`` labelled
documents, chosen by a hash of their ids, and on at most ``max_lines``
neighbouring lines of each, from a place chosen by a hash (the documented
bounds of the sample).  Scores are of whole texts.

Forward and backward messages are running products of 2 x 2 matrices.  The
matrix at a document's first line has equal rows, which makes what stands before it
a mere factor, so the lines of many documents are one chain; it is worked on in
blocks side by side, and a text of very many lines takes no longer than many texts.

Cases: null and empty texts are one empty line; repeated rows get equal
results; documents that share an id are one in training (the least by the hash
of its text), and so are labels (the smaller one); null labels, and ids on one
side only, take no part; without labels every score is 0.5; texts of any length
are read whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, slices
from .fim import flat

#: What a line's own features are, in the order of the columns of :func:`line_features`.
FEATURES = (
    "log bytes", "log words", "upper letters", "symbols", "digits", "stops", "other bytes", "word length", "short words", "bare symbols",
    "words that end in a symbol", "capital words", "distinct words", "distinct pairs", "seen elsewhere", "ends a sentence", "empty",
)
#: Bytes of text that are worked on at once.
SLICE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Standardised features beyond this many deviations count as that.
FAR = 5.0


def _class(letters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters.encode())] = True
    return out


UPPER, LOWER, DIGIT = (np.array([a <= c <= b for c in range(256)]) for a, b in ((65, 90), (97, 122), (48, 57)))
STOP, SPACE, OTHER = _class(".,;:?!'\"-()"), _class(" \t\r\v\f"), np.arange(256) > 127
SYMBOL = ~(UPPER | LOWER | DIGIT | OTHER | SPACE | STOP | _class("\n")) | _class("!")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(of: np.ndarray, hashes: np.ndarray, groups: int) -> np.ndarray:
    """Number of distinct hashes of each group."""
    mixed = (hashes ^ (of.astype(np.uint64) + np.uint64(1)) * ODD) * ODD
    _, first = np.unique(mixed, return_index=True)
    return np.bincount(of[first], minlength=groups)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of texts end to end, the bytes of each line, and the number of each text's first line; a text has one line at least."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    lines = np.bincount(owner, minlength=len(offsets) - 1) + 1
    first = np.cumsum(lines) - lines
    start = np.empty(int(lines.sum()), np.int64)
    start[first] = offsets[:-1]
    rest = np.ones(len(start), bool)
    rest[first] = False
    start[rest] = breaks + 1
    end = np.empty_like(start)
    end[:-1] = start[1:]
    end[-1:] = offsets[-1]
    end[np.flatnonzero(rest) - 1] -= 1  # without the break itself
    size = end - start

    def of_lines(kind: np.ndarray) -> np.ndarray:
        """Bytes of a kind in each line; one running sum at a time, as it takes several bytes for each byte of text."""
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)])
        return total[end] - total[start]

    upper, symbol, digit, stop, other = (of_lines(k) for k in (UPPER, SYMBOL, DIGIT, STOP, OTHER))
    held = upper + of_lines(LOWER) + other
    solid = ~(SPACE[data] | (data == 10))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, stops = solid & edge[:-1], solid & edge[1:]
    begins[1:] |= solid[1:] & ~solid[:-1]
    stops[:-1] |= solid[:-1] & ~solid[1:]
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    line = np.searchsorted(start, begins, "right") - 1
    # of an empty last line and the next text's first, which begin at the same byte, the latter holds the word
    many = lambda weights=None: np.bincount(line, weights, len(start))
    powers = np.cumprod(np.full(len(data) + 1, ODD))
    rolled = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)])
    hashed = lambda a, b: (rolled[b] - rolled[a]) * powers[len(data) - a]

    words, long = many(), stops - begins
    word = hashed(begins, stops)
    pair = np.flatnonzero(line[1:] == line[:-1])
    pairs = np.bincount(line[pair], minlength=len(start))
    twice = word[pair] * np.uint64(3) ^ word[pair + 1]
    text = np.repeat(np.arange(len(lines)), lines)
    mixed = (hashed(start, end) ^ (text.astype(np.uint64) + np.uint64(1)) * ODD) * ODD
    _, same, copies = np.unique(mixed, return_inverse=True, return_counts=True)
    final = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(len(start), np.uint8)
    letter = UPPER | LOWER | OTHER
    odd = np.concatenate([[0], np.cumsum(SYMBOL[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)])
    bare = odd[stops] - odd[begins] == long
    columns = [
        np.log1p(size), np.log1p(words), np.sqrt(_share(upper, held)), np.sqrt(_share(symbol, size)), np.sqrt(_share(digit, size)), np.sqrt(_share(stop, size)), np.sqrt(_share(other, size)),
        np.log1p(_share(many(long), words)), _share(many(long <= 3), words), np.sqrt(_share(many(bare), words)),
        np.sqrt(_share(many(SYMBOL[data[stops - 1]]), words)), _share(many(UPPER[data[begins]]), words), _share(_distinct(line, word, len(start)), words),
        _share(_distinct(line[pair], twice, len(start)), pairs), (copies[same] > 1) & (size > 0), (size > 0) & ~letter[final] & ~SYMBOL[final], size == 0,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1), size, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Standardised features with those of the lines before and after, zero beyond an end, and marks of both ends and of any line."""
    heads = np.zeros(len(own), bool)
    heads[first] = True
    tails = np.roll(heads, -1)
    tails[-1:] = True
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[heads], after[tails] = 0, 0
    return np.concatenate([own, before, after, heads[:, None], tails[:, None], np.ones((len(own), 1))], 1)


def _times(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, their four entries along the first axis, scaled to a largest entry of 1."""
    x = np.stack([p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]])
    return x / np.maximum(np.maximum(x[0], x[1]), np.maximum(x[2], x[3]))


def _products(m: np.ndarray) -> np.ndarray:
    """Running products of 2 x 2 matrices up to factors; blocks of them are worked on side by side."""
    n = len(m)
    long = max(1, math.isqrt(n))
    count = -(-n // long)
    whole = np.concatenate([m.reshape(n, 4), np.broadcast_to(np.eye(2).ravel(), (count * long - n, 4))])
    out = np.ascontiguousarray(whole.reshape(count, long, 4).transpose(2, 1, 0))
    for t in range(1, long):
        out[:, t] = _times(out[:, t - 1], out[:, t])
    for k in range(1, count):
        out[:, :, k] = _times(out[:, -1:, k - 1], out[:, :, k])
    return out.transpose(2, 1, 0).reshape(-1, 2, 2)[:n]


@dataclass
class Model:
    """Weights of the features, scores of neighbouring labels, and the features' means and deviations."""

    weights: np.ndarray
    pairs: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def standard(self, own: np.ndarray) -> np.ndarray:
        return np.clip((own - self.mean) / self.spread, -FAR, FAR)


def marginals(scores: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability to be good, and those of its label pair with the line before (zero at first lines)."""
    n = len(scores)
    if not n:
        return np.empty(0), np.empty((0, 2, 2))
    node = np.stack([np.zeros(n), np.clip(scores, -300, 300)], 1)
    node = np.exp(node - node.max(1, keepdims=True))
    heads = np.zeros(n, bool)
    heads[first] = True
    step = np.exp(np.where(heads[:, None, None], 0.0, pairs)) * node[:, None, :]
    alpha = _products(step)[:, 0]
    back = np.concatenate([np.where(heads[1:, None, None], 1.0, step[1:]), np.ones((1, 2, 2))])
    beta = _products(back[::-1].transpose(0, 2, 1)).transpose(0, 2, 1)[::-1].sum(2)
    good = alpha * beta
    both = np.zeros((n, 2, 2))
    both[1:] = alpha[:-1, :, None] * step[1:] * beta[1:, None, :]
    both[heads] = 0
    return (good / good.sum(1, keepdims=True))[:, 1], both / np.maximum(both.sum((1, 2), keepdims=True), 1e-300)


def train(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair scores of greatest likelihood (less ``decay`` times their squares), each document counting alike."""
    lines = np.diff(np.r_[first, len(x)])
    each = np.repeat(1 / (lines * len(first)), lines)
    y = np.repeat(label, lines).astype(float)
    heads = np.zeros(len(x), bool)
    heads[first] = True
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[~heads].astype(int), y[~heads].astype(int)), each[~heads])
    theta, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for k in range(1, rounds + 1):
        good, both = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        g = np.concatenate([x.T @ (each * (y - good)), (seen - (both * each[:, None, None]).sum(0)).ravel()]) - 2 * decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def sample(docs: DataFrame, labels: DataFrame, max_documents: int, max_lines: int, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, label, features): the sampled documents, features of their lines as float32 bytes."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(label).cast("int").alias("label"))
    total = known.count()
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("id"), 33) <= (1 << 31) * max_documents // max(total, max_documents, 1))
    asked = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                own, _, first = line_features(*flat(part.column(0)))
                out = []
                for a, b, h in zip(first.tolist(), [*first[1:].tolist(), len(own)], part.column(3).to_pylist(), strict=True):
                    a += h % max(1, b - a - max_lines + 1)
                    out.append(own[a : min(b, a + max_lines)].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.array(out, pa.binary())], ["id", "label", "h", "features"])

    kind = docs.schema[key].dataType.simpleString()
    rows = asked.select("text", "id", "label", F.shiftrightunsigned(F.xxhash64("text"), 33).alias("h")).mapInArrow(arrow(run), f"id {kind}, label int, h bigint, features binary")
    return rows.groupBy("id").agg(F.min(F.struct("h", "label", "features")).alias("r")).select("id", "r.label", "r.features")


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 3000, max_lines: int = 64, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on about ``max_documents`` labelled documents and at most ``max_lines`` lines of each."""
    width = len(FEATURES)
    rows = sample(docs, labels, max_documents, max_lines, key, text, label).toArrow().sort_by("id")
    if not rows.num_rows:
        return Model(np.zeros(3 * width + 3), np.zeros((2, 2)), np.zeros(width), np.ones(width))
    parts = [np.frombuffer(f, "<f4").reshape(-1, width) for f in rows.column("features").to_pylist()]
    own = np.concatenate(parts).astype(np.float64)
    lines = np.array([len(p) for p in parts])
    first = np.cumsum(lines) - lines
    spread = own.std(0)
    model = Model(np.zeros(0), np.zeros(0), own.mean(0), np.where(spread > 1e-6, spread, 1.0))
    model.weights, model.pairs = train(with_neighbours(model.standard(own), first), first, rows.column("label").to_numpy())
    return model


def document_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's score and the probability of each of its lines."""
    own, size, first = line_features(data, offsets)
    good, _ = marginals(with_neighbours(model.standard(own), first) @ model.weights, model.pairs, first)
    weight = size + 1.0
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), good


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``score`` (0 to 1, higher is better) and ``lines``, the probability of each line to be good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                data, offsets = flat(part.column(1))
                found, good = document_scores(shared.value, data, offsets)
                first = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(offsets, np.flatnonzero(data == 10), "right") - 1, minlength=len(found)) + 1)])
                lines = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(good, pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(found, 0, 1), pa.float64()), lines], [key, "score", "lines"])

    return docs.select(key, text).mapInArrow(arrow(run), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, lines array<double>")
