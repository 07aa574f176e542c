"""Each stage of the pipeline against what it should keep."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import SparkSession

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark: SparkSession, tmp_path) -> None:
    rng = random.Random(9)
    words = ["the", "cat", "sat", "on", "mat", "dog", "ran", "far", "und", "der"]
    rows = [(i, " ".join(rng.choices(words, k=60)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end", "en", "s0", 1) for i in range(10)] + [(200, "12 34 !!", "en", "s0", 1), (201, None, None, None, None), (None, "the cat sat on a mat", "en", "s1", 1), (5, rows[5][1], "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "mixture", "tokens"]
    one = stages["language"](spark, docs, str(tmp_path)).collect()
    assert len(one) == len(rows) - 2 and list(one[0].asDict()) == list(corpus_pipeline.COLUMNS)
    docs = spark.createDataFrame(one, docs.schema)
    two = stages["near_duplicates"](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in two) == Counter([*range(60), None])
    docs = spark.createDataFrame(two, docs.schema)
    three = stages["mixture"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in three} <= {r.doc_id for r in two} and max(Counter(r.doc_id for r in three).values()) <= 2 and len(three) > len(two)
    four = stages["tokens"](spark, spark.createDataFrame(three, docs.schema), str(tmp_path)).collect()
    assert Counter(r.doc_id for r in four) == Counter(r.doc_id for r in three) and all(len(r.ids) == 4 * r.n_tokens for r in four)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(four)


def test_stages_by_force(spark: SparkSession, tmp_path) -> None:
    """Each stage's rows against a plain version of what it decides, with ties, repeated rows and an extra column."""
    from test_operators import groups_by_force, language_by_force, reference_tokenizer, water_filling

    rng = random.Random(13)
    words = {"aa": ["dop", "odo", "pod", "opo"], "bb": ["mit", "tim", "imi", "tmi"]}
    rows = []
    for i in range(90):
        k = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choices(words[k], k=40)), k if i % 5 else None, f"s{i % 3}", 1))
    rows += [(200 + i, rows[i][1] + " " + rng.choice(["dop", "mit"]), None, "s1", 1) for i in range(20)] + [(300, "12 !", None, None, 1), (301, "", None, None, 1), (302, None, "aa", "s0", 1), (7, *rows[7][1:])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, word string")
    stages = dict(corpus_pipeline.STAGES)
    one = [tuple(r) for r in stages["language"](spark, table, "").collect()]
    learned = [(r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None]
    told = [(r, language_by_force(learned, r[1])[0]) for r in rows]
    assert Counter(one) == Counter((*r[:2], r[2] or k, *r[3:]) for r, k in told if k != "und")
    docs = spark.createDataFrame(one, ", ".join(table.schema[c].simpleString().replace(":", " ") for c in corpus_pipeline.COLUMNS))
    two = [tuple(r) for r in stages["near_duplicates"](spark, docs, "").collect()]
    groups = groups_by_force([(i, r[1]) for i, r in enumerate(sorted(set(one)))], 5, 80)
    best = {}
    for i, r in enumerate(sorted(set(one))):
        best.setdefault(groups[i][1], r)
    assert Counter(two) == Counter(best.values()) and len(two) < len(one) - 15
    three = [tuple(r) for r in stages["mixture"](spark, spark.createDataFrame(two, docs.schema), "").collect()]
    sizes = Counter()
    for r in two:
        sizes[r[3]] += len(r[1].split())
    order = sorted(sizes)
    targets = water_filling([sizes[k] for k in order], [3, 1, 2], 1.5 * sum(sizes.values()))
    for k, target in zip(order, targets, strict=True):
        assert abs(sum(len(r[1].split()) for r in three if r[3] == k) - target) <= 41
    assert set(three) <= set(two) and max(Counter(three).values()) <= 2
    tokens = stages["tokens"](spark, spark.createDataFrame(three, docs.schema), "").collect()
    library, texts = reference_tokenizer(), {r[0]: r[1] for r in three}
    assert Counter(r.doc_id for r in tokens) == Counter(r[0] for r in three)
    for r in tokens:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.n_tokens == len(ids)


def test_empty_and_unlabelled_tables(spark: SparkSession, tmp_path) -> None:
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rows = [(1, "some text", None, None, 1), (2, "12", None, None, 1), (3, None, None, "s", 1)]
    assert [r.doc_id for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, kind), "").collect()] == [1]


def test_tokens_take_one_python_process_a_task(spark: SparkSession) -> None:
    """An encoder and a decoder in a row stay side by side in an executor's memory; one process gives what both gave."""
    import public_tokenizers

    from rooftide.llm import bpe

    path, schema = public_tokenizers.path("word_bpe_49k.json"), "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["The cat sat, THE CAT SAT.", "", None, " \t\n", "naïve Σίσυφος é 漢字 \U0001f600", "a\x1cb c", "x" * 5000, "word " * 3000, "<unk> and </s>", "The cat sat, THE CAT SAT."]
    docs = spark.createDataFrame([(None if i == 3 else i, t, None, None, None) for i, t in enumerate(texts)], schema)
    tokens = dict(corpus_pipeline.STAGES)["tokens"]
    out = tokens(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    both = bpe.decode(bpe.encode(docs, path), path)
    assert Counter(map(tuple, bpe.round_trip(docs, path).collect())) == Counter(map(tuple, both.collect()))
    assert Counter((r.doc_id, bytes(r.ids)) for r in out.collect()) == Counter((r.doc_id, bytes(r.ids)) for r in both.collect())
    assert tokens(spark, docs.limit(0), "").count() == 0
