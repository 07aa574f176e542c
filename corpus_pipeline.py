"""A training corpus from ``documents``: language ID, near-duplicate removal, mixing, BPE.

Each stage takes all rows that the stage before kept.  All but the last return
the columns of ``documents``.  SQL can express neither the language model nor
the tokeniser, so there is no SQL for the whole; the tests hold each stage
against a brute-force version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rooftide.llm import bpe, langid, mixing, neardup
from rooftide.llm.common import shared_folder, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told, which fills a null ``lang``; those without letters go.

    Without any label no language is told, and documents with letters stay as they are.  Null and empty texts go;
    repeated rows all stay; an empty table gives an empty one; columns beside those of documents are dropped.
    """
    small_batches(spark)
    model = langid.fit(docs)
    found = langid.predict(docs, model, keep=COLUMNS)
    told = found.where(F.col("lang_pred") != "und") if model.languages else found.where(F.coalesce(F.col("kept_text").rlike(r"\p{L}"), F.lit(False)))
    lang = F.coalesce("kept_lang", F.when(F.col("lang_pred") != "und", F.col("lang_pred"))).alias("lang")
    return told.select(*(lang if c == "lang" else F.col(f"kept_{c}").alias(c) for c in COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its 5-word shingles; rows without a word or a key all stay.

    Of rows that are equal in key and text one stays; rows that share a key alone are documents of their own.
    """
    small_batches(spark)
    return neardup.one_of_each(docs.select(*COLUMNS), words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2 in turn, 1.5 times as many words as there are, no source more than twice.

    Null and empty texts have no words and come once, where their source is taken at least once as a whole; a null
    source is a source.
    """
    return mixing.repeated(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of what they decode to; a null text has none."""
    small_batches(spark)
    back = bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return back.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept in the shared folder."""
    docs, place = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
