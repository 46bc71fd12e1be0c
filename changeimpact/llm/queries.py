"""Registered queries of the training-data operators: each runs over its whole table with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeimpact.llm import (
    alignment, chat, decontaminate, embedding_join, html_text, neardup, pii, quality_rules, sentencepiece_codec, sharding,
    substrings, warc, whitening,
)
from changeimpact.llm.check_sql import ORACLES  # noqa: F401  (read by the driver contract)
from changeimpact.llm.common import shared_folder, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = neardup.near_duplicates(docs, shingle=2, percent=80)
    return judged.select("doc_id", "n_shingles", "component_id", "kept")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read(spark, path)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = quality_rules.measures(docs).drop("text")
    judged = quality_rules.quality_of(measured, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shuffled(docs).select("doc_id", *sharding.RESULT)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [
        F.size(F.filter("base_spans", of)).cast("long").alias(f"n_{kind}")
        for kind, of in ((k, (lambda i: lambda s: s.kind == i)(i)) for i, k in enumerate(pii.KINDS))
    ]
    base = F.sha2(pii.written(F.col("base_spans")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.written(F.concat("base_spans", "added_spans")).alias("spans"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"), keep_unlinked=True)


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """Place of a vocabulary file; it is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digests(sentencepiece_codec.encode(docs, vocabulary()))


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embedding_join.near_duplicates(vectors, at_least=0.93).select("vec_id", "n_links", "component_id", "kept")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned, _ = alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary(), digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=32)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_minhash": op2_minhash,
    "op3_html": op3_html,
    "op4_warc": op4_warc,
    "op5_substrings": op5_substrings,
    "op6_quality_rules": op6_quality_rules,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_chat": op9_chat,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_embeddings": op11_embeddings,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}

