"""Fill-in-the-middle, spelling variants and line quality against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rooftide.llm import fim, quality, queries, spelling

DOCS = "doc_id long, text string, lang string, source string, n long, form string, word string, score string, label int"
ODD = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "é\n你好\n\nß", "has <M> inside\nb", "line of text\n" * 4000, "x" * 70_000, " \t", "last\nwithout end"]


def docs(spark: SparkSession, texts: list, ids: list | None = None):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash", "clash", 3) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def plain_split(key: object, text: str | None, unit: str = r"[^\n]*\n|[^\n]+", seed: int = 7) -> tuple:
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(unit, text, re.S if unit == "." else 0)
    n = len(units)
    k1, k2 = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = ("".join(units[x:y]) for x, y in ((0, k1), (k1, k2), (k2, n)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    return (n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 50 else (n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=1300), st.integers(0, 3))
def test_bits_count_and_find(marks: list, stretch: int) -> None:
    bits = np.repeat(np.array(marks, bool), 1 + 7 * stretch)
    b, where = fim.Bits(bits), np.flatnonzero(bits)
    assert b.rank(np.arange(len(bits) + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    if len(where):
        assert b.select(np.arange(len(where))).tolist() == where.tolist()


@pytest.mark.parametrize(("unit", "pattern"), [("line", r"[^\n]*\n|[^\n]+"), ("char", ".")])
def test_middle_moved_and_rebuilt(spark: SparkSession, unit: str, pattern: str) -> None:
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choices("ab é你<SPM>\n", k=rng.randrange(60))) for _ in range(300)), "a\nb", None]
    ids = [*range(len(texts) - 3), None, 5, 5]
    frame = docs(spark, texts, ids).repartition(3)
    found = fim.split(frame, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert found[0].asDict().keys() >= {"text", "source", "word", "n", "form"}
    want = Counter((i, t or "", *plain_split(i, t, pattern)) for i, t in zip(ids, texts, strict=True))
    assert Counter((r.doc_id, r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found) == want
    assert fim.split(docs(spark, []), unit=unit).count() == 0


def test_middle_shares_and_seeds(spark: SparkSession) -> None:
    frame = docs(spark, [f"a\nb\nc{i}" for i in range(400)])
    share = lambda **more: Counter(r.form for r in fim.split(frame, **more).select("form").collect())
    assert share(fim_percent=0) == {"plain": 400}
    assert share(spm_percent=0) == {"psm": 400}
    assert 120 < share(fim_percent=50)["plain"] < 280
    outputs = lambda seed: [r.output for r in fim.split(frame, seed=seed).orderBy("doc_id").collect()]
    assert outputs(7) == outputs(7) != outputs(8)


def plain_words(rows: list, shortest: int = 7, least: int = 2, slip: int = 31) -> dict:
    counts: Counter[str] = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts: dict, factor: int = 10) -> dict:
    near: dict[str, list[str]] = defaultdict(list)
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in counts if near[w]}
    form = {w: v for w, v in best.items() if counts[v] >= factor * counts[w]}

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def test_words_are_counted(spark: SparkSession) -> None:
    rng = random.Random(2)
    texts = [None, "", *(" ".join("".join(rng.choices("abcÀÉ×ÿZ", k=rng.randrange(1, 12))) + rng.choice([".", "1", "", "\n", "ā"]) for _ in range(80)) for _ in range(60)), "Abcdefg abcdefG " * 500, "z" * 90_000]
    ids = [None, None, *range(len(texts) - 3), 7]
    frame = docs(spark, [*texts, texts[5], texts[5]], [*ids, 3, None]).repartition(3)
    rows = [*zip(ids, texts, strict=True), (3, texts[5]), (None, texts[5])]
    for shortest, slip in ((7, 31), (3, 2)):
        found = {r.word: r.n for r in spelling.words(frame, shortest=shortest, slip=slip).collect()}
        assert found == plain_words(rows, shortest, 2, slip)


@pytest.mark.parametrize(("large", "small"), [(50_000, 24), (40, 3), (9, 2), (400, 1)])
def test_variants_by_force(spark: SparkSession, large: int, small: int) -> None:
    rng = random.Random(large)
    words = {"".join(rng.choices("abé", k=rng.randrange(3, 9))) for _ in range(700)}
    words |= {"the" + "".join(rng.choices("abcdefgh", k=rng.randrange(2, 6))) + "ing" for _ in range(400)}
    words |= {"p" * k + x for k in (6, 7, 2000) for x in ("", "q", "qp", "pq")}
    counts = {w: rng.choice([2, 3, 20, 40, 400, 4000, 90_000]) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    found = spelling.variants(frame, large=large, small=small).collect()
    assert len(found) == len(counts)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == plain_variants(counts)


def test_long_chains_end_at_their_root(spark: SparkSession) -> None:
    counts = {"aaaaaaa"[:k] + "bbbbbbb"[k:]: 2 * 10**k for k in range(8)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r.word: r.root for r in spelling.variants(frame).collect()}
    assert set(found.values()) == {"aaaaaaa"}
    assert spelling.variants(frame.where("n < 0")).count() == 0


def test_a_pair_stands_in_one_block() -> None:
    rng = random.Random(4)
    spelled = [w.encode() for w in {"".join(rng.choices("ab", k=n)) for n in (8, 9) for _ in range(300)}]
    rows = len(spelled)
    for small in (1, 5, 10_000):
        found = [p for i, j in spelling.pairs_of(spelling.Batch(8, spelled), np.zeros(rows, int), np.zeros(rows, int), np.zeros(rows, int), small) for p in zip(i.tolist(), j.tolist(), strict=True)]
        want = {frozenset(p) for p in itertools.combinations(range(rows), 2) if one_edit(spelled[p[0]].decode(), spelled[p[1]].decode()) and min(len(spelled[k]) for k in p) == 8}
        assert len(found) == len(want) and {frozenset(p) for p in found} == want


def test_marginals_are_those_of_all_labellings() -> None:
    rng = np.random.default_rng(3)
    lengths = [1, 4, 7, 2, 1, 6]
    scores, pairs = rng.normal(0, 2, sum(lengths)), rng.normal(0, 1.5, (2, 2))
    first = np.cumsum(lengths) - lengths
    good, both = quality.marginals(scores, pairs, first)
    for start, n in zip(first, lengths, strict=True):
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            weight[y] = np.exp(sum(scores[start + i] * y[i] for i in range(n)) + sum(pairs[y[i - 1], y[i]] for i in range(1, n)))
        whole = sum(weight.values())
        for i in range(n):
            assert good[start + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / whole)
            for a, b in itertools.product((0, 1), repeat=2) if i else ():
                assert both[start + i, a, b] == pytest.approx(sum(w for y, w in weight.items() if (y[i - 1], y[i]) == (a, b)) / whole)
    far, _ = quality.marginals(np.tile([90.0, -90.0], 20_000), pairs * 9, np.array([0]))
    assert np.isfinite(far).all()


def test_training_climbs_the_likelihood() -> None:
    rng = np.random.default_rng(1)
    x, first = rng.normal(0, 1, (12, 3)), np.array([0, 4, 5, 9])
    y = np.array([1, 0, 1, 0])

    def likelihood(w: np.ndarray, pairs: np.ndarray, decay: float = 0.05) -> float:
        total = 0.0
        for a, b, label in zip(first, [*first[1:], 12], y, strict=True):
            s = x[a:b] @ w
            weight = {v: sum(s[i] * v[i] for i in range(b - a)) + sum(pairs[v[i - 1], v[i]] for i in range(1, b - a)) for v in itertools.product((0, 1), repeat=b - a)}
            total += (weight[(label,) * (b - a)] - np.log(sum(np.exp(v) for v in weight.values()))) / (b - a) / 4
        return total - decay * (np.square(w).sum() + np.square(pairs).sum())

    w, pairs = quality.train(x, first, y, 600, 0.05, 0.05)
    best = likelihood(w, pairs)
    for _ in range(60):
        assert likelihood(w + rng.normal(0, 0.05, 3), pairs + rng.normal(0, 0.05, (2, 2))) < best + 1e-4


def test_line_features_by_hand() -> None:
    texts = ["One two one two.\n\nABC*** | 12", "", "same\nsame\n", "é"]
    data, offsets = fim.flat(__import__("pyarrow").array(texts))
    own, size, first = quality.line_features(data, offsets)
    col = lambda name: own[:, quality.FEATURES.index(name)].round(6).tolist()
    assert size.tolist() == [16, 0, 11, 0, 4, 4, 0, 2] and first.tolist() == [0, 3, 4, 7]
    assert col("distinct words") == [1.0, 0, 1, 0, 1, 1, 0, 1]  # "One" and "two." differ from "one" and "two"
    assert col("empty") == [0, 1, 0, 1, 0, 0, 1, 0]
    assert col("seen elsewhere") == [0, 0, 0, 0, 1, 1, 0, 0]
    assert col("upper letters")[2] == 1 and col("ends a sentence")[0] == 1
    assert col("words that end in a symbol")[2] == round((2 / 3) ** 0.5, 6) and col("bare symbols")[2] == round((1 / 3) ** 0.5, 6)
    alone = [quality.line_features(*fim.flat(__import__("pyarrow").array([t])))[0] for t in texts]
    assert np.allclose(np.concatenate(alone), own)


def test_quality_on_held_out_documents(spark: SparkSession) -> None:
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.QUERIES["op13_line_crf_quality"](spark, folder).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    held = [(found[d], y) for d, y in labels if d in found and found[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in found.items())
    assert len(held) > 80 and sum(r.predicted == y for r, y in held) >= 0.97 * len(held)


def test_quality_of_odd_tables(spark: SparkSession) -> None:
    frame = docs(spark, [*ODD, "again", "again"], [*range(len(ODD)), None, 3])
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, 1), (None, 1), (9, None), (99, 0), (12, 0)], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    found = quality.score(frame, model).collect()
    assert Counter(r.doc_id for r in found) == Counter([*range(len(ODD)), None, 3]) and all(0 <= r.score <= 1 for r in found)
    assert {r.doc_id: len(r.lines) for r in found if r.doc_id in (0, 1, 9)} == {0: 1, 1: 1, 9: 4001}
    none = quality.fit(frame, labels.where("false"))
    assert {r.score for r in quality.score(frame, none).collect()} == {0.5}
    assert quality.score(docs(spark, []), model).count() == 0
    lone = quality.fit(docs(spark, ["Good text.\nMore of it."] * 40, [1] * 40), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert np.isfinite(lone.weights).all()
