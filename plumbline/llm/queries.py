"""Queries over the whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, interactions, langid, linededup, maxent, media, quality, resample, simhash, substrings, toxicity, wrappers
from plumbline.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.decode(bpe.encode(docs, vocab), vocab))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(langid.remainder(5) == 0, F.lit(False))
    learned = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(langid.remainder(5) != 0)
    model = toxicity.fit(docs, learned)
    return toxicity.tag(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", F.to_json("spans").alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.members(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(langid.remainder(4) == 2, F.lit(False))
    prototypes = langid.learn(docs.where(langid.remainder(4) != 2))
    return langid.predict(docs.select("doc_id", "text"), prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.match(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sounds and pictures, some with another picture behind them, and types declared without a look."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"), "text", media.declared(F.col("text")).alias("declared"))
    found = media.sniff(media.pack(docs, kinds=media.KINDS, thumbnails=media.THUMBNAILS).drop("text"))
    return found.withColumn("read", media.features(F.col("content"), F.col("media_type"))).select(
        "doc_id", "n_bytes", "read.payload_bytes", "read.payload_sha256", "read.tail_crc32", F.octet_length("content").cast("long").alias("media_bytes"), F.sha2("content", 256).alias("media_sha256"), "read.feature", "media_type", "media_length", "declared", "corrected", F.size("embedded").alias("n_embedded")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source, its path the section of that source in its language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    classifier = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.grade(docs, classifier)


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = maxent.score(docs, langid.remainder(7) != 2)
    held = F.coalesce(langid.remainder(7) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.run(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_html": op6_html,
    "op7_substrings": op7_substrings,
    "op8_decontamination": op8_decontamination,
    "op9_media": op9_media,
    "op10_quality": op10_quality,
    "op11_lm_score": op11_lm_score,
    "op12_filter_audit": op12_filter_audit,
    "op13_resample": op13_resample,
}

ORACLES: dict[str, str] = {
    "op5_line_dedup": linededup.ORACLE,
    "op12_filter_audit": interactions.ORACLE,
    "op13_resample": resample.ORACLE,
}
