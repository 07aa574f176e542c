"""One registered query per training-data operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, cut, held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of the decoded text for every document."""
    import public_tokenizers

    from . import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    back = bpe.decode(tokens, path)
    return back.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from . import html_extract

    found = html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records of two replicas, the second one with damage at fixed ids, and what the audit finds."""
    from . import warc

    def damaged(page: Column, content: Column) -> Column:
        return F.when(page % 97 == 13, F.concat(F.expr("substring(content, 1, octet_length(content) - 1)"), F.lit(b"?"))).otherwise(content)

    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    first = cut(warc.inventory(pages))
    second = cut(warc.inventory(pages, stored=damaged).where(F.coalesce(F.col("page_id") % 89 != 7, F.lit(True))))
    tree = warc.nodes(first)
    found = warc.audit(first.drop("page_id"), second.drop("page_id"), tree).select("archive", "offset", "verdict")
    joined = first.join(found, ["archive", "offset"], "left").join(warc.roots(tree), "archive")
    return joined.select(
        "page_id",
        "archive",
        F.col("offset").alias("record_offset"),
        F.col("length").alias("record_length"),
        F.col("digest").alias("record_sha256"),
        F.col("root").alias("root_sha256"),
        F.coalesce("verdict", F.lit("ok")).alias("verdict"),
    )


@query
def op4_pivot_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for each vector whose id is divisible by 20."""
    from . import topk

    found = topk.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op5_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes from it."""
    from . import mixing

    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


@query
def op6_word_first_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the model learns from those that are not held out."""
    from . import langid

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4))
    model = langid.fit(docs.where(~F.col("held_out")))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")


@query
def op8_jpeg_dc_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as the DC terms of baseline JPEG, read back, with digests and thumbnail hashes."""
    from . import jpeg

    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("text", "payload")
    read = jpeg.describe(jpeg.store(docs))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(thumbnail, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "frames", "thumb_hash").alias("feature"),
    )


@query
def op9_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot of 24; shard sizes in rows differ by one at most."""
    from . import shard

    placed = shard.external_shuffle(table(spark, sf_dir, "documents", "doc_id", "text"), 24)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_setsketch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 85 % of their 3-word shingles or more."""
    from . import neardup

    return neardup.groups(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=85)


@query
def op10_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a context-tree model of those that are not held out."""
    from . import ctw

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = ctw.fit(docs.where(~held_out(F.col("doc_id"), 7)))
    found = ctw.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


@query
def op11_rank_select_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and the text that is rebuilt from it."""
    from . import fim

    moved = fim.split(table(spark, sf_dir, "documents", "doc_id", "text"), keep=("doc_id",))
    back = fim.restored(F.col("output"), F.col("form"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query
def op12_forward_reversed_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters or more with the near word whose misspelling it seems to be."""
    from . import spelling

    counted = spelling.words(table(spark, sf_dir, "documents", "doc_id", "text"))
    return spelling.variants(counted)


@query
def op13_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its lines; the model learns from labels of documents that are not held out."""
    from . import quality

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    hidden = F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(~hidden)
    model = quality.fit(docs, labels)
    found = quality.score(docs, model)
    return found.select("doc_id", hidden.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _oracles() -> None:
    from . import fim, mixing, neardup, spelling, topk, warc

    ORACLES["op11_rank_select_middle"] = fim.ORACLE
    ORACLES["op12_forward_reversed_dictionaries"] = spelling.ORACLE

    ORACLES["op3_merkle_fixity"] = warc.ORACLE
    ORACLES["op4_pivot_elimination"] = topk.ORACLE
    ORACLES["op5_capped_water_filling"] = mixing.ORACLE
    ORACLES["op7_setsketch_groups"] = neardup.ORACLE


_oracles()
