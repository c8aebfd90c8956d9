"""A training corpus from ``documents``: five stages, each over all that its predecessor kept.

What all stages share: a null text is read as an empty one, long texts are read whole, no
documents give none, and columns beside those of ``documents`` pass through all stages but
the last, whatever their names.  Rows that repeat are judged alike; ``simhash_dedup`` keeps
one of them.  A null doc_id is no reason to drop a row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, langid, linededup, simhash
from plumbline.llm.common import free_name, small_batches, table
from plumbline.sources.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null and empty texts among them.

    Once two languages are learned, any text with letters is nearest to one of them and
    stays, however unlike both; of a single language, texts whose cosine with it isn't
    positive go as well.
    """
    small_batches(spark)
    prototypes = langid.learn(docs.where(langid.remainder(4) != 2))
    guess = free_name(docs, "guess")
    found = docs.withColumn(guess, langid.guess(prototypes, F.col("text")))
    return found.where((F.col(guess)["lang_pred"] != langid.UNKNOWN) & (F.col(guess)["score"] > 0)).drop(guess)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that many documents share; every document stays, if need be with an empty text.

    A line stays in the document of largest doc_id; of rows that repeat it, in all.
    """
    small_batches(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = linededup.dedup(docs.select("doc_id", "text", F.struct(F.lit(0), *rest).alias("rest")))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return kept.select(*[columns.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near copies: five-word SimHash within two bits, or five-word sets similar by 0.8.

    Wordless texts are copies of each other.  Of a group of null doc_ids alone one text stays.
    """
    small_batches(spark)
    return simhash.keep_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whole or edited; wordless texts and items hold and match nothing."""
    small_batches(spark)
    leaks = free_name(docs, "leaks")
    return decontam.match(docs, table(spark, sf_dir, "benchmark"), into=leaks).where(F.size(leaks) == 0).drop(leaks)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it again; an empty text has none.  Of the columns doc_id, lang and source stay."""
    small_batches(spark)
    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    found = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocab), vocab)
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SimHash groups and language prototypes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
